"""Column functions shared by all reports."""

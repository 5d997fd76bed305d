"""The reports, as functions from orders to DataFrames."""

"""Revenue-quality analytics on Spark: star schema, reports and what-if repricing."""

"""Point-in-time market analytics on Spark: bars, features, labels, datasets and reference data as DataFrame operations."""

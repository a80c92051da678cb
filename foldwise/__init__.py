"""Time-series validation and training-data preparation on Spark."""

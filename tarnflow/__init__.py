"""Time-series, stream-job and key-value analytics on Spark DataFrames."""

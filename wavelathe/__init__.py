"""Time-series and vector feature analytics on Spark."""

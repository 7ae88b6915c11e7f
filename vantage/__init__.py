"""vantage: spatial-capture and point-scene analytics on Spark DataFrames."""

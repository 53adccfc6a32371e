"""Source-concentration analytics on Spark DataFrames."""

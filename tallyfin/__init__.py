"""Financial time-series analytics on Spark DataFrames."""

"""Symbol-sequence analytics on Spark DataFrames."""

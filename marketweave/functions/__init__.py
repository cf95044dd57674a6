"""Market and news analytics on Spark DataFrames."""

"""News-trust analytics on Spark DataFrames."""

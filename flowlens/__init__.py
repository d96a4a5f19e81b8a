"""Network security log analytics on Spark DataFrames."""

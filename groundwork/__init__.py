"""Source-grounded document analytics on Spark DataFrames."""

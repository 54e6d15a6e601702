"""Vector quantisation analytics on Spark DataFrames."""

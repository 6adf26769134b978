"""Code-graph indexing, search and evaluation analytics on Spark DataFrames."""

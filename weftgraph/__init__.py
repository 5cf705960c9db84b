"""Property-graph and code-graph analytics on Spark DataFrames."""

"""Code-graph analytics over Spark DataFrames."""

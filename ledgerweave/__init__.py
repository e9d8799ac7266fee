"""Government-finance knowledge-graph analytics on Spark DataFrames."""

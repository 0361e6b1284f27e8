"""Graph, recommendation and flow analytics on Spark DataFrames."""

"""factloom: typed-fact retrieval and evaluation on Spark DataFrames."""

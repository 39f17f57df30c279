"""quire: corpus analytics on Spark DataFrames."""

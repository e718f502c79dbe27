"""Evidence-retrieval analytics on Spark DataFrames."""

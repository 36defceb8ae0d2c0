"""tamis: cited retrieval and text-collection analytics on Spark DataFrames."""

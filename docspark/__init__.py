"""Document-corpus and table operators for Spark DataFrames."""

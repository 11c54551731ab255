"""quire: build and query document corpora with Spark DataFrames."""

"""lexispan: full-text search, ranking and highlighting on Spark DataFrames."""

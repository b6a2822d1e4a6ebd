"""strata: a corpus of source files as a property graph, on Spark DataFrames."""

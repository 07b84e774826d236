"""roundsmith: match assembly, hybrid retrieval and reporting over Spark DataFrames."""

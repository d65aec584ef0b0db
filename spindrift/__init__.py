"""Document-retrieval and analytics engine expressed in Spark DataFrames."""

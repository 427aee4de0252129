"""quarry: a retrieval and corpus engine on Spark DataFrames."""

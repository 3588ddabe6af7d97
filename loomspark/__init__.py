"""Session analytics over long agent conversations, built on Spark DataFrames."""

"""threadloom: article-index analytics on Spark DataFrames."""

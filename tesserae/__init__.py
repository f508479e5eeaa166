"""A catalog and search engine on Spark DataFrames."""

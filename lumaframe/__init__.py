"""Media and encode analytics on Spark DataFrames."""

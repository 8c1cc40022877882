"""Product-price analytics on Spark DataFrames."""

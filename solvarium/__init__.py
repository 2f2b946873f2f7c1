"""Package-repository analytics on Spark DataFrames."""

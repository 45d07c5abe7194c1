"""Object-centric event analytics on Spark DataFrames."""

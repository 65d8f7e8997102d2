"""grovetally: hierarchy, size and corpus analytics on Spark DataFrames."""

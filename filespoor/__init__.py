"""Software fingerprint analytics on Spark DataFrames."""

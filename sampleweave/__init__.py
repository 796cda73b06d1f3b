"""Signal analytics on Spark: ordered, sampled streams and their tags as DataFrames."""

"""graphloom: reference-graph analytics on Spark DataFrames."""

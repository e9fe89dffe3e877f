"""pathloom: weighted-graph analytics on Spark DataFrames."""

"""graphloom: property-graph and retrieval analytics on Spark DataFrames."""

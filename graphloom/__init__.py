"""graphloom: probabilistic knowledge hypergraphs and corpus preparation on Spark DataFrames."""

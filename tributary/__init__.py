"""tributary: record linkage and funding-flow analytics on Spark DataFrames."""

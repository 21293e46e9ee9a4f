"""erario: monthly public-budget execution analytics on Spark DataFrames."""

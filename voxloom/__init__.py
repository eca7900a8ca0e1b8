"""voxloom: labelled volumes, region graphs, skeletons and connectivity tables as Spark DataFrames."""

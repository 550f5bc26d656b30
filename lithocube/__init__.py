"""Depth-resolved ground-deformation analytics on Spark DataFrames."""

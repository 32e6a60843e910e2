"""Hierarchical manifold analytics on Spark DataFrames."""

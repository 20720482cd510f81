"""Dependency-graph and contract analytics on Spark DataFrames."""

"""Graphloom: a workspace knowledge graph, and its lookups, on Spark DataFrames."""

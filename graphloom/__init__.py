"""Graphloom: code-graph analytics expressed as Spark DataFrames."""

"""Nearest-neighbour analytics over dense vector tables, on Spark DataFrames."""

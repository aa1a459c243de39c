"""Exact set analytics over fixed-shape discrete records, planned as Spark DataFrames."""

"""Directional mobility analytics on Spark DataFrames."""

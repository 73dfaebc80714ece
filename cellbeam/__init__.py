"""Adaptive-grid analytics on Spark DataFrames."""

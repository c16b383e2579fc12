"""Streaming anomaly analytics on Spark DataFrames."""

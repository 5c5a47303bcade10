"""Batch, streaming and incremental analytics over Spark DataFrames."""

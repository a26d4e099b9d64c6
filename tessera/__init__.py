"""Immune-repertoire analytics on Spark DataFrames."""

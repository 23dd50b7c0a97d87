"""Geo-occurrence analytics on Spark DataFrames."""

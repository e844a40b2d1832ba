"""Terraloom: geospatial analytics as Spark DataFrames."""

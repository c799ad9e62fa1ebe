"""Landscape analytics on Spark: rasters, vectors, profiles and graphs as DataFrames."""

"""Raster analytics and vectorisation on Spark."""

"""Raster analytics on Spark: images, glyphs, features and classifiers as DataFrames."""

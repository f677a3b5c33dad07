"""Palette analytics on Spark: images as DataFrames of pixels."""

"""Volumetric analytics on Spark: volumes, blocks, labels and results are DataFrames."""

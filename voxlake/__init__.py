"""Volumetric feature analytics, and text corpus jobs, on Spark DataFrames."""

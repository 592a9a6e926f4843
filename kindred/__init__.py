"""Structural diff and kinship analytics on Spark DataFrames."""

"""Fuzzy address-to-place scoring on Spark DataFrames."""

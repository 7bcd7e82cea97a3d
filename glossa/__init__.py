"""Glossa: semantic indexing of text on Spark DataFrames."""

"""Concept-pair analytics on Spark DataFrames."""

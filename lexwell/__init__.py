"""Fuzzy multilingual full-text search over Spark DataFrames."""

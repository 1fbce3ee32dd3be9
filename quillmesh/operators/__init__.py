"""Relational operators of the relevance engine: DataFrames in, DataFrames out."""

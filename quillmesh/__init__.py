"""Spark-native relevance, indexing and corpus engine."""

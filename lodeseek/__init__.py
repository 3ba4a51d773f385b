"""Spark-native document and code index with hybrid search."""

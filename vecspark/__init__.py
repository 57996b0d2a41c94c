"""Spark-native vector search and evaluation analytics."""

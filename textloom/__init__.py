"""Spark-native corpus, packing and evaluation analytics."""

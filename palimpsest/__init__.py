"""Spark-native engine for curating large text corpora."""

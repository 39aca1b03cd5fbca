"""Spark-native engine for building and curating text corpora."""

"""Spark-native content analytics: search, catalogue, merge, timeline and text operators."""

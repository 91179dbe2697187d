"""Spark-native terminology learning: alignment, co-occurrence, term matching, learned dictionaries and metrics."""

"""Spark-native analytics over shared segments and sparse rare-variant records."""

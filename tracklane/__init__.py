"""Spark-native analytics over timed sequences."""

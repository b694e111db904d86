"""Spark-native analytics for grouping assembled sequence fragments."""

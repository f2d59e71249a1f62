"""Spark-native analytics over block-partitioned integer sequences."""

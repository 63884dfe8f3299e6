"""Spark-native analytics over host audit and performance data."""

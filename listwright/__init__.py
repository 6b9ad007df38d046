"""Spark-native analytics over marketplace-style listing data."""

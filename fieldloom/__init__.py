"""Spark-native analytics over fields, symbols, point sets and rate-distortion records."""

"""Spark-native analytics over head-to-head competition data."""

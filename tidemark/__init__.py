"""Spark-native analytics over windowed document streams and market series."""

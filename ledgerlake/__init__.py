"""Spark-native analytics for personal-finance ledgers."""

"""Spark-native analytics for time-coded text."""

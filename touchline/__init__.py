"""Spark-native analytics for player-level sports event data."""

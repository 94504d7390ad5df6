"""Spark-native duplicate, usage and text analytics engine."""

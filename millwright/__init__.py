"""Spark-native analytics for predictive maintenance."""

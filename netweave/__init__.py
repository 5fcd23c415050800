"""Spark-native analytics of grouped features and feature networks."""

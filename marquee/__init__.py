"""Spark-native listings analytics."""

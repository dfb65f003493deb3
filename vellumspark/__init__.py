"""Spark-native document and vector analytics."""

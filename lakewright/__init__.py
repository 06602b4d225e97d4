"""Spark-native catalogue search and document analytics."""

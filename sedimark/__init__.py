"""Spark-native analytics over source history, mail archives and embedding tables."""

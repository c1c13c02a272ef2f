"""Tidemark: a Spark-native engine that turns collections of documents into a searchable evidence index."""

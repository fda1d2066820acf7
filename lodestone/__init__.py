"""Lodestone: a Spark-native engine for preparing, indexing and querying text corpora."""

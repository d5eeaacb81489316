"""Spark-native corpus processing: normalisation, hybrid retrieval, incremental indexing and reports."""

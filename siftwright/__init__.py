"""Spark-native retrieval, ranking and data-maintenance operators."""

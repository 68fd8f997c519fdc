"""Spark-native consolidation, validation and guarded querying of messy tables."""

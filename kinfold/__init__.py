"""Spark-native detection of duplicate and near-duplicate content."""

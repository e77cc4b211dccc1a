"""Spark-native engine for grounded document retrieval analytics."""

"""Spark-native field lineage and corpus engine."""

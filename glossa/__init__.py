"""Spark-native retrieval, vector compression and text reduction engine."""

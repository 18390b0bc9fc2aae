"""Spark-native multi-objective sequence analytics."""

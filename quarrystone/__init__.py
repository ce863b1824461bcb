"""Quarrystone: a Spark-native document, chunk, vector and graph analytics engine."""

__version__ = "0.1.0"

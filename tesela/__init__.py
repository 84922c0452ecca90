"""Spark-native text retrieval, corpus storage and corpus analytics."""

__version__ = "0.1.0"

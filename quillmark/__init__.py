"""Spark-native indexing and ranked retrieval of document and code collections."""

__version__ = "0.1.0"

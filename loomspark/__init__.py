"""Spark-native retrieval and data-processing engine for code and documents."""

__version__ = "0.1.0"

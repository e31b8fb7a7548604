"""Tidemark: a Spark-native analytics engine for tagged time-series tables."""

__version__ = "0.1.0"

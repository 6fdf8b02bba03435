"""Quillmark: a Spark-native analytics engine for question banks and other categorised, dated text."""

__version__ = "0.1.0"

"""Spark-native analytics over large typed knowledge graphs."""

__version__ = "0.1.0"

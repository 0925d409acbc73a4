"""Spark-native analytics over spreadsheet-shaped relations."""

__version__ = "0.1.0"

"""Spark-native analytics over extracted business documents."""

__version__ = "0.1.0"

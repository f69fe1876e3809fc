"""Spark-native analytics toolkit: DataFrames in, DataFrames out."""

__version__ = "0.1.0"

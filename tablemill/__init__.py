"""Spark-first operators for moving, shaping and checking tables."""

__version__ = "0.1.0"

"""Quarry: a Spark-native data conversion and analytics engine.

Every operator takes and returns DataFrames; nothing here keeps state of its own.
"""

__version__ = "0.1.0"

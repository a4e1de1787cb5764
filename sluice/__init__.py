"""PySpark-native rule evaluation and data preparation for HTTP transactions."""

__version__ = "0.1.0"

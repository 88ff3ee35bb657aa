"""millrace: a PySpark-native batch retrieval engine."""

__version__ = "0.1.0"

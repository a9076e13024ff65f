"""gritmill: a PySpark-native engine for source-code, version-history and corpus analytics."""

__version__ = "0.1.0"

"""varve: a PySpark-native engine for sparse entity x feature count data."""

__version__ = "0.1.0"

"""cairn: a PySpark-native engine for versioned, content-addressed data."""

__version__ = "0.1.0"

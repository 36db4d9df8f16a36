"""A PySpark-native engine for versioned catalogs of nested records."""

__version__ = "0.1.0"

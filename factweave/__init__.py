"""factweave: a PySpark-native engine over multi-tenant JSON facts and typed tables."""

__version__ = "0.1.0"

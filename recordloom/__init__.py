"""recordloom: a PySpark-native engine for large stores of short, timestamped fact records."""

__version__ = "0.1.0"

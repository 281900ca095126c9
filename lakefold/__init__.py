"""lakefold: a PySpark-native analytics engine for entity, time-series, statement and document data."""

__version__ = "0.1.0"

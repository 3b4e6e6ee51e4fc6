"""larkspur: a PySpark-native SQL analytics engine and event/record processing library."""

__version__ = "0.1.0"

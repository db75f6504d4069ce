"""loomtext: a PySpark-native analytics engine for text corpora."""

__version__ = "0.1.0"

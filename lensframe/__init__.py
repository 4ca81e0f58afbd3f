"""lensframe: a Spark-native engine for messy operational data."""

__version__ = "0.1.0"

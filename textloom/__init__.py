"""textloom: a Spark-native engine for preparing text datasets."""

__version__ = "0.1.0"

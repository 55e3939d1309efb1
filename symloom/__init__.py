"""symloom: a Spark-native analytics engine for source-code graphs."""

__version__ = "0.1.0"

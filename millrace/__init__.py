"""millrace: a Spark-native analytics engine (DataFrame, SQL and Structured Streaming)."""

__version__ = "0.1.0"

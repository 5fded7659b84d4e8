"""A Spark-native engine for change data."""

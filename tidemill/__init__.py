"""A Spark-native engine for event-stream analytics."""

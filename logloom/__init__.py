"""A Spark-native engine for security logs."""

"""sedimenta: Spark-native analytics for code-history and event data."""

"""A Spark-native lakehouse engine for machine events and other tables."""

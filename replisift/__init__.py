"""A PySpark-native engine over versioned, tombstoned file indexes."""

"""A PySpark-native engine for document evidence at corpus scale."""

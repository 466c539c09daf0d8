"""A PySpark-native engine for text and speech analytics."""

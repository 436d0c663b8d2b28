"""A PySpark-native terrain analytics engine."""

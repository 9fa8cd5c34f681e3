"""A PySpark-native analytics engine for entity by month panels."""

"""sightline: a PySpark-native engine for observation analytics."""

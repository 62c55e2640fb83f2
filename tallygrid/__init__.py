"""A PySpark-native engine for option-ranking data."""

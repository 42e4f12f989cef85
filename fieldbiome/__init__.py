"""PySpark-native analytics for environmental-genomics surveillance tables."""

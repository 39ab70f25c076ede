"""PySpark-native analytics and statistical-genetics engine."""

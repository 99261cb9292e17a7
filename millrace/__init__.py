"""A PySpark-native analytics engine with a rich analytical SQL dialect."""

"""A PySpark-native analytics engine over knowledge bases of qualified facts."""

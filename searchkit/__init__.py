"""searchkit: a PySpark-native engine to search, facet and maintain collections of records."""

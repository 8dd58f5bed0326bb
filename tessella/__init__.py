"""tessella: a PySpark-native geospatial layer engine."""

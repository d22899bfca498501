"""PySpark-native analytics over document knowledge: text, grids, vectors, logs and typed evidence graphs."""

"""A Spark-native engine for n-dimensional grids."""

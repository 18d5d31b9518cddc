"""Spark-native analytics for grid time series, events and object tracks."""

"""Spark-native analytics for site-level time-series forecasting."""

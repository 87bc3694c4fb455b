"""Spark-native change analytics over pixel series, and the tables around them."""

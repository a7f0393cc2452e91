"""Spark-native semantic screening of large text collections."""

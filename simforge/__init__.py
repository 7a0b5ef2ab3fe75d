"""Spark-native program-similarity analytics."""

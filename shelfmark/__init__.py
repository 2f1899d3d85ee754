"""Spark-native analytics over collections of archived web captures."""

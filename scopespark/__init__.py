"""Spark-native analytics for experiment, literature and graph tables."""

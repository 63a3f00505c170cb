"""Spark-native analytics over source text, findings, change history and labelled datasets."""

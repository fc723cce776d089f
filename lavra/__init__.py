"""Spark-native analytics over text corpora, conversation logs and source code."""

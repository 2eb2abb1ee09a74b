"""Spark-native analytics for feeds of text items, with tools for training corpora in ``llm``."""

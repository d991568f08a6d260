"""Spark-native analysis of framed signals, and of text corpora in the optional subpackage ``llm``."""

"""Spark-native address analytics: relational operators, text functions, retrieval, metrics and streaming."""

"""Spark-native analytics for temporal interaction graphs and candidate reranking."""

"""Spark-native analytics operators for entity, relationship and capital-markets data."""

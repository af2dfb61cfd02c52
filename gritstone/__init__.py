"""gritstone: a Spark-native catalogue, deduplication and similarity engine."""

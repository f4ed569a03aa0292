"""A Spark-native retrieval and analytics engine for text corpora."""

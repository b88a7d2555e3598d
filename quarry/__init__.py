"""Spark-native retrieval and analytics over versioned technical documents."""

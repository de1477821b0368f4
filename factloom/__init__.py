"""Spark-native versioned knowledge-graph analytics."""

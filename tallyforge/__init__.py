"""Spark-native analytics for entity-over-time scoring and multi-source fact reconciliation."""

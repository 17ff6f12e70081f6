"""Spark-native analytics over industrial knowledge, telemetry and text tables."""

"""Spark-native exact-duplicate and run-telemetry analytics."""

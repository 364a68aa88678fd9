"""Spark-native telemetry analytics: pure DataFrame operators over metrics, logs, events, spans and inventories."""

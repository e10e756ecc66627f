"""Spark-native analytics over multimodal operations telemetry."""

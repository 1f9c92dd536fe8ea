"""Spark-native complaint-triage and civic-knowledge analytics."""

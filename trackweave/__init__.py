"""Spark-first analytics for multi-object trajectory data."""

"""Spark-first analytics over captured model internals."""

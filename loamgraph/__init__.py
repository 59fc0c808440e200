"""Spark-first engine for artifact graphs, chunk tables and retrieval queries."""

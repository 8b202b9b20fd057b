"""Retrieval, dependency-graph and training-data analytics as PySpark DataFrame operators."""

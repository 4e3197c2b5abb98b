"""Spark-first retrieval analytics: patches, vector stores, evidence ranking and evaluation."""

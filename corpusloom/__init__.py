"""Bulk retrieval-and-grounding analytics over document corpora on PySpark."""

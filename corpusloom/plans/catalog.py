"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from corpusloom.plans import (
    queries_answers,
    queries_documents,
    queries_graph,
    queries_retrieval,
    queries_store,
    queries_streaming,
)
from corpusloom.plans.registry import QUERIES

__all__ = [
    "QUERIES",
    "queries_answers",
    "queries_documents",
    "queries_graph",
    "queries_retrieval",
    "queries_store",
    "queries_streaming",
]

"""Registered queries: the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.plans import ingestion as ing
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w
from corpusloom.plans.registry import query

OUT = (
    "tenant_id", "document_id", "emit_order", "relation", "source_kind", "source_name",
    "target_kind", "target_name", "source_span",
)


@query
def edges_from_metadata(spark, d):
    return graph.edges_from_metadata(ing.metadata(spark, d)).select(*OUT)


@query
def edges_from_topics(spark, d):
    meta, hits = r.head_hits(spark, d)
    return graph.edges_from_topics(hits, meta).select(*OUT)


@query
def topic_cooccurrence(spark, d):
    meta, hits = r.head_hits(spark, d)
    return graph.topic_cooccurrence(hits, meta).select(*OUT, "confidence")


@query
def edge_dedup(spark, d):
    return r.head_edges(spark, d).select("edge_id", *OUT)


@query
def edge_status(spark, d):
    return r.head_edges(spark, d).select("tenant_id", "edge_id", "validation_status")


@query
def resolve_entities(spark, d):
    return graph.resolve_entities(r.store(spark, d).edges)


@query
def expand_aliases(spark, d):
    return graph.expand_aliases(graph.resolve_entities(r.store(spark, d).edges))


@query
def graph_search(spark, d):
    hits, _ = r.graph_candidates(r.store(spark, d), w.questions(spark, d))
    return hits.select("tenant_id", "query_id", "edge_id", "relation", "edge_rank")


@query
def graph_to_chunks(spark, d):
    return r.graph_candidates(r.store(spark, d), w.questions(spark, d))[1]

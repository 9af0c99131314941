"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows

QUICK = (
    "page_text_gate", "exact_duplicate_docs", "normalize_text", "sanitize_text", "confirmed_overlay",
    "tokenize_corpus", "chunk_headers", "bm25_search", "cosine_topk_chunks", "rrf_fuse", "hybrid_retrieve",
    "fit_context", "graph_search", "graph_to_chunks", "edge_dedup", "expand_aliases", "plan_queries",
    "rewrite_queries", "assess_evidence", "audit_answers", "final_answers", "recall_at_k", "ndcg_at_k",
    "generation_summary", "apply_status_updates", "upsert_chunks", "stream_stage_metrics", "stream_ingest",
)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(cur.fetchall(), names)


def test_every_copy_has_its_class(spark, sf, con):
    test_matches_sql(spark, sf, con, "class_members")
    got = entry.queries()["class_members"](spark, sf)
    assert got.columns == ["tenant_id", "chunk_id", "representative", "members"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

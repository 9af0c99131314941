"""Answer audit, metrics, store and telemetry on small tables."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, evaluate, graph, store, telemetry


def audited(spark, answer, sources=3, score=0.9, status="vigente_confirmada", article=None):
    a = spark.createDataFrame([("t", 1, answer)], "tenant_id string, answer_id long, answer string")
    rows = [("t", 1, i, score, status, f"RDC {i}/2020", article or f"Art. {i}", f"{i}.md") for i in range(1, sources + 1)]
    c = spark.createDataFrame(rows, "tenant_id string, answer_id long, source_no int, score double, status string, regulation_number string, article string, filename string")
    return audit.audit_answers(a, c).first()


def test_clean_answer(spark):
    row = audited(spark, "O prazo é de cinco anos [Fonte 1]. Deve guardar. [Fonte 2]")
    assert row["cited"] == [1, 2] and row["grounded"] and not row["requires_review"] and row["reasons"] == []


def test_forms_of_citation(spark):
    assert audited(spark, "x [Fontes 1 e 3] (fonte 2) [FONTE 1]")["cited"] == [1, 3, 2]
    assert audited(spark, "x [Fonte 1-3]")["cited"] == [1, 3]
    assert audited(spark, "x Fonte 1")["cited"] == []


def test_invented_source(spark):
    row = audited(spark, "x [Fonte 9] y [Fonte 1]")
    assert row["invalid"] == ["9"] and row["grounded"] and row["requires_review"]
    assert row["reasons"] == ["A resposta citou fontes inexistentes: 9"]


def test_nothing_valid_stops_the_audit(spark):
    row = audited(spark, "Deve guardar. [Fonte 7]", score=0.1, status=None)
    assert row["reasons"] == ["A resposta citou fontes inexistentes: 7", "A resposta nao citou nenhuma fonte valida."]


def test_conflict_unverified_borderline(spark):
    row = audited(spark, "x [Fonte 1, 2]", score=0.5, status="revogada_confirmada", article="Art. 5")
    assert len(row["reasons"]) == 3 and row["reasons"][0].startswith("Ha normas diferentes")


def test_unsupported_sentences(spark):
    row = audited(spark, "Deve guardar. Geralmente sim. Texto comum. É vedado vender. [Fonte 1]")
    assert row["unsupported"] == 2


def test_no_sources_at_all(spark):
    a = spark.createDataFrame([("t", 1, "x [Fonte 1]")], "tenant_id string, answer_id long, answer string")
    c = spark.createDataFrame([], "tenant_id string, answer_id long, source_no int, score double, status string, regulation_number string, article string, filename string")
    row = audit.answer_outcome(audit.final_answers(audit.audit_answers(a, c))).first()
    assert row["outcome"] == "no_context" and row["final_answer"].startswith("Não encontrei") and row["cited_sources"] == []


def metrics(spark, retrieved, gold, k=5):
    q = spark.createDataFrame([("t", 1)], "tenant_id string, query_id long")
    r = spark.createDataFrame([("t", 1, i, d) for i, d in enumerate(retrieved, 1)], "tenant_id string, query_id long, rank int, document string")
    g = spark.createDataFrame([("t", 1, x) for x in gold], "tenant_id string, query_id long, gold string")
    return evaluate.retrieval_metrics(q, r, g, k).first()


def test_retrieval_metrics(spark):
    row = metrics(spark, ["rdc67.md", "b.md", "c.md"], ["RDC67"])
    assert (row["recall"], row["precision"], row["hit_rate"], row["mrr"], row["ndcg"]) == (1.0, 0.333333, 1.0, 1.0, 1.0)
    row = metrics(spark, ["a.md", "x.md"], ["x", "y"])
    assert (row["recall"], row["mrr"]) == (0.5, 0.5)
    row = metrics(spark, ["a.md"], [])
    assert row["recall"] is None and row["ndcg"] is None
    row = metrics(spark, [], ["x"])
    assert (row["recall"], row["precision"], row["mrr"], row["ndcg"]) == (0.0, 0.0, 0.0, 0.0)


def test_gain_counts_repeats(spark):
    assert metrics(spark, ["x.md", "x.md"], ["x"])["ndcg"] > 1


def test_generation_summary(spark):
    cols = "should_answer boolean, http_status int, grounded boolean, abstained boolean, cited_sources int, document_hit_at_5 boolean, keyword_coverage double, duration_ms long, embed_ms long, load_duration_ms long, chat_ms long, tokens_per_second double"
    rows = [
        (True, 200, True, False, 1, True, 1.0, 10, 0, 0, 5, 10.0),
        (True, 200, False, False, 0, False, 0.5, 20, 4, 0, 0, 0.0),
        (False, 200, False, True, 0, None, None, 30, 2, 0, 0, 0.0),
        (True, 500, False, False, 0, None, None, 99, 0, 0, 0, 0.0),
    ]
    row = evaluate.generation_summary(spark.createDataFrame(rows, cols)).first()
    assert (row["cases_total"], row["cases_ok"], row["grounded_rate"], row["citation_precision"], row["abstention_accuracy"], row["recall_at_5"]) == (4, 3, 0.5, 1.0, 1.0, 0.5)
    assert (row["p50"], row["p95"], row["mean"], row["embedding_mean"], row["model_load_mean"]) == (20.0, 29.0, 20.0, 3.0, None)


def test_upsert_refuses_another_tenant(spark):
    rows = spark.createDataFrame([("t", "t:d:1", "d", "a")], "tenant_id string, chunk_id string, document_id string, text string")
    bad = spark.createDataFrame([("t", "u:d:1", "d", "b")], rows.schema)
    new = spark.createDataFrame([("t", "t:d:1", "d", "b"), ("t", "t:d:2", "d", "c")], rows.schema)
    assert sorted(r["text"] for r in store.upsert_chunks(rows, new).collect()) == ["b", "c"]
    with pytest.raises(Exception):
        store.upsert_chunks(rows, bad).collect()


def test_status_update_rewrites_the_header(spark):
    rows = spark.createDataFrame([("t", "d", "t:d:1", "A\nStatus informado: Vigencia nao verificada\n\ncorpo", "vigencia_nao_verificada")], "tenant_id string, document_id string, chunk_id string, text string, status string")
    up = spark.createDataFrame([("t", "d", "vigente_confirmada", "ana", "2024")], "tenant_id string, document_id string, status string, validated_by string, validated_at string")
    row = store.apply_status_updates(rows, up).first()
    assert row["text"] == "A\nStatus informado: Vigencia confirmada\n\ncorpo" and row["validated_by"] == "ana"
    bad = up.withColumn("status", F.lit("valendo"))
    with pytest.raises(Exception):
        store.apply_status_updates(rows, bad).collect()


def test_status_counts_indexed_chunks_with_and_without_terms(spark):
    texts = ["Art. 5", "de da", "", "ação", "é", "٣/١٩٩٠", "o 7", None, "É de DA", "dade", "da1", "-", "артикул", "para x"]
    rows = [("t", f"d{i % 3}", i, "vigente_confirmada", x) for i, x in enumerate(texts)]
    plain = spark.createDataFrame(rows, "tenant_id string, document_id string, chunk int, status string, text string")
    with_terms = T.with_tokens(plain, "text")
    a, b = (sorted(map(str, store.knowledge_base_status(x).collect())) for x in (plain, with_terms))
    each = T.with_has_terms(with_terms, "text", "has").select("text", "has", (F.size("tokens") > 0).alias("want")).collect()
    assert a == b and all(bool(r["has"]) == bool(r["want"]) for r in each) and {r["has"] for r in each} >= {True, False}


@pytest.mark.parametrize("name", ["knowledge_base_status", "write_report"])
def test_status_queries_match_sql(spark, sf, name):
    import duckdb

    import __spark_entry__ as entry
    from tools.compare import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert rows(map(tuple, df.collect()), df.columns) == rows(cur.fetchall(), names)


def test_prune_keeps_the_cutoff(spark):
    e = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-03', interval 1 day)) created_at")
    assert telemetry.prune_expired(e, "2024-01-02").count() == 2 and telemetry.prune_expired(e, None).count() == 3


def test_sessions_batch_equals_window_sessions(spark, sf):
    from corpusloom.plans import workload as w

    e = w.timed(w.table(spark, sf, "events"))
    e = e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")))  # one busy user
    a = sorted(map(tuple, telemetry.sessions(e, 600).select("user_id", "start", "last", "events").collect()))
    b = sorted(map(tuple, telemetry.sessions_batch(e, 600).select("user_id", "start", "last", "events").collect()))
    assert a == b and len(a) > 10


def test_model_relations(spark):
    raw = '{"relation":"regula","target":"x","confidence":9} {"relation":"nada","target":"y"} {"relation":"revoga","object":"' + "z" * 300 + '","source_kind":"?"}'
    out = graph.ingest_model_relations(spark.createDataFrame([(1, raw)], "doc_id long, raw string")).orderBy("edge_no").collect()
    assert [(o["relation"], o["target_kind"], o["confidence"], len(o["target_name"]), o["source_kind"]) for o in out] == [("regula", "tema", 0.85, 1, None), ("revoga", "tema", 0.55, 255, None)]


def test_grid_drops_impossible_overlap():
    assert len(evaluate.build_grid()) == 36
    assert evaluate.build_grid((100,), (50, 100), (0.5,)) == [(100, 50, 0.5, "sweep_100_50_50")]

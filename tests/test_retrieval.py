"""Search, fusion, selection and budget on small tables, checked by hand or by brute force."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS
from corpusloom.operators import context, fusion, graph, lexical, neighbours, planning, vectors
from corpusloom.plans import evaluation as ev
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w

TEXTS = [
    ("a", "RDC 67/2007 boas práticas de manipulação"),
    ("b", "RDC 67/2007 controle de qualidade do art. 5"),
    ("c", "Portaria 344/98 lista de substâncias"),
    ("d", "AFE autorização de funcionamento"),
    ("e", "SNGPC escrituração"),
    ("f", "de para com"),
]


def corpus(spark, tenant="t"):
    return spark.createDataFrame([(tenant, "doc", i, x) for i, x in TEXTS], "tenant_id string, document_id string, chunk_id string, text string")


def ask(spark, *questions, tenant="t"):
    return spark.createDataFrame([(tenant, i, q) for i, q in enumerate(questions)], "tenant_id string, query_id long, question string")


def test_bm25_against_the_formula(spark):
    hits = lexical.bm25_search(lexical.inverted_index(lexical.chunk_tokens(corpus(spark))), ask(spark, "lista SNGPC")).collect()
    lengths = {"a": 9, "b": 10, "c": 8, "d": 3, "e": 2}
    tokens = {x["chunk_id"]: x["doc_len"] for x in lexical.chunk_tokens(corpus(spark)).collect()}
    assert set(tokens) == set(lengths)  # the text of stopwords is not in the index
    avg = sum(tokens.values()) / 5
    idf = math.log(1 + (5 - 1 + 0.5) / 1.5)
    want = {i: round(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * tokens[i] / avg)), 6) for i in ("c", "e")}
    assert {h["chunk_id"]: h["bm25_score"] for h in hits} == pytest.approx(want)


def test_a_stored_index_moves_no_postings(spark):
    many = corpus(spark).crossJoin(spark.range(2000)).select(
        "tenant_id", F.concat("document_id", "id").alias("document_id"), F.concat("chunk_id", "id").alias("chunk_id"), "text"
    )
    tokens, q = lexical.chunk_tokens(many), ask(spark, "RDC 67/2007", "qualidade lista AFE")
    found = lexical.bm25_search(lexical.stored_index(tokens), q)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexical.bm25_search(lexical.inverted_index(tokens), q).collect()))
    moves = [line for line in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) == 1 and "query_id" in moves[0] and "document_id" not in moves[0]


def test_tenants_do_not_mix(spark):
    both = corpus(spark, "t").unionByName(corpus(spark, "u"))
    hits = lexical.bm25_search(lexical.inverted_index(lexical.chunk_tokens(both)), ask(spark, "AFE", tenant="u"))
    assert {h["tenant_id"] for h in hits.collect()} == {"u"}


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([], [1.0], 0.0), ([0.0], [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert vectors.cosine_pairs(df, "a", "b").filter("cosine <> want").count() == 0


def brute(chunks, queries, k):
    out = {}
    for t, q, v in queries:
        v = np.array(v)
        scored = []
        for tt, cid, x in chunks:
            if tt != t:
                continue
            x = np.array(x)
            n = np.linalg.norm(v) * np.linalg.norm(x)
            s = 0.0 if n == 0 or len(x) != len(v) else float(np.clip(v @ x / n, 0, 1))
            scored.append((-round(s, 6), cid))
        out[(t, q)] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


def vector_case(spark):
    rng = np.random.default_rng(3)
    chunks = [(f"t{i % 2}", f"c{i:03d}", rng.normal(size=8).round(3).tolist()) for i in range(300)]
    chunks += [("t0", f"z{i:03d}", chunks[0][2]) for i in range(100)]  # a third are copies
    chunks += [("t0", "zero", [0.0] * 8), ("t0", "short", [1.0])]
    queries = [(f"t{i % 2}", i, chunks[i][2]) for i in range(10)]
    c = spark.createDataFrame(chunks, "tenant_id string, chunk_id string, embedding array<double>")
    q = spark.createDataFrame(queries, "tenant_id string, query_id long, embedding array<double>")
    c = c.withColumn("embedding", F.col("embedding").cast("array<float>"))
    return c, q, brute([(a, b, np.float32(v).tolist()) for a, b, v in chunks], queries, 7)


def grouped(df):
    out = {}
    for h in df.orderBy("vector_rank").collect():
        out.setdefault((h["tenant_id"], h["query_id"]), []).append((h["chunk_id"], h["score"]))
    return out


def test_exact_search_against_brute_force(spark):
    c, q, want = vector_case(spark)
    assert grouped(vectors.cosine_topk(c.repartition(5), q, k=7)) == want


def test_exact_search_in_small_blocks(spark, monkeypatch):
    c, q, want = vector_case(spark)
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 5)
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 2)
    monkeypatch.setattr(vectors, "MAX_KEPT", 20)
    assert grouped(vectors.cosine_topk(c, q, k=7)) == want


def test_probing_every_cell_is_exact_and_few_cells_recall_most(spark):
    c, q, want = vector_case(spark)
    c = c.filter("chunk_id not in ('short')")
    every = grouped(vectors.ann_topk(c, q, 7, cells=4, probes=4))
    assert every == want
    few = grouped(vectors.ann_topk(c, q, 7, cells=4, probes=2))
    shared = sum(len(set(few[k]) & set(want[k])) for k in want) / sum(len(v) for v in want.values())
    assert shared >= 0.6


def test_embedder_contract(spark):
    class Model:
        def embed(self, texts):
            assert len(texts) <= 16
            return np.array([[len(t), 1.0] for t in texts])

    df = spark.range(40).select(F.col("id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    out = vectors.embed_with(df, Model).collect()
    assert all(row["embedding"] == [float(row["id"]), 1.0] for row in out)


def test_same_text_same_vector(spark):
    out = vectors.embed_chunks(spark.createDataFrame([("a b",), ("a b",), ("",)], "text string")).collect()
    assert out[0]["embedding"] == out[1]["embedding"] and sum(map(abs, out[2]["embedding"])) == 0


def test_one_model_per_collection(spark):
    df = spark.createDataFrame([("t", [1.0], "m1"), ("t", [1.0], "m2"), ("u", [1.0], "m1")], "tenant_id string, embedding array<float>, embedding_model string")
    got = {x["tenant_id"]: x["conflict"] for x in vectors.embedding_model_guard(df).collect()}
    assert got == {"t": True, "u": False}
    with pytest.raises(ValueError):
        vectors.assert_one_model(df, "m1")


def hits(spark, rows, rank, *names):
    cols = "tenant_id string, query_id long, chunk_id string, " + f"{rank} int" + "".join(f", {n} double" for n in names)
    return spark.createDataFrame([("t", 1, *row) for row in rows], cols)


def test_fusion_sums_and_order(spark):
    near = hits(spark, [("a", 1, 0.8), ("b", 2, 0.78)], "vector_rank", "score")
    words = hits(spark, [("b", 1, 9.0, 1.0, 0.7), ("c", 2, 4.0, 4 / 9, 0.3)], "bm25_rank", "bm25_score", "lexical_score", "cosine")
    found = hits(spark, [("g", 1, 0.5), ("b", 2, 0.5)], "graph_rank", "score")
    out = {x["chunk_id"]: x for x in fusion.rrf_fuse(near, words, found).collect()}
    assert out["b"]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61 + 1 / 62, abs=1e-8)
    assert (out["b"]["rank"], out["a"]["rank"], out["g"]["rank"], out["c"]["rank"]) == (1, 2, 3, 4)
    assert out["b"]["vector_score"] == 0.78 and out["c"]["vector_score"] == 0.3 and out["g"]["vector_score"] == 0.5


def test_fusion_drops_ghosts(spark):
    near = hits(spark, [("a", 1, 0.8)], "vector_rank", "score")
    words = hits(spark, [("gone", 1, 9.0, 1.0, 0.0)], "bm25_rank", "bm25_score", "lexical_score", "cosine")
    stored = spark.createDataFrame([("t", "a")], "tenant_id string, chunk_id string")
    assert [x["chunk_id"] for x in fusion.rrf_fuse(near, words, None, stored).collect()] == ["a"]


CANDIDATE = "tenant_id string, query_id long, chunk_id string, rank int, document_id string, chunk int, tokens array<string>, vector_score double, lexical_score double, exact_reference boolean"


def candidates(spark, rows):
    return spark.createDataFrame([("t", 1, *row) for row in rows], CANDIDATE)


def test_greedy_dedup(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [
        ("a", 1, "d1", 1, base, 0.9, 0.0, False),
        ("copy", 2, "d2", 9, base, 0.9, 0.0, False),
        ("near", 3, "d1", 2, base[:12] + ["x", "y"], 0.9, 0.0, False),
        ("far", 4, "d1", 5, base[:12] + ["x", "y"], 0.9, 0.0, False),
        ("other", 5, "d3", 1, ["q"], 0.9, 0.0, False),
    ]
    kept = fusion.dedup_candidates(candidates(spark, rows)).collect()
    assert sorted(k["chunk_id"] for k in kept) == ["a", "far", "other"]


def test_relevance_escape(spark):
    rows = [
        ("low", 1, "d", 1, ["a"], 0.44, 0.9, False),
        ("ref", 2, "d", 5, ["b"], 0.1, 0.5, True),
        ("weak", 3, "d", 9, ["c"], 0.1, 0.49, True),
        ("edge", 4, "d", 20, ["d"], 0.45, 0.0, False),
    ]
    out = fusion.select_context(candidates(spark, rows)).orderBy("source_no").collect()
    assert [x["chunk_id"] for x in out] == ["ref", "edge"]


def test_rerank_orders(spark):
    rows = [(c, i, "d", i, ["x"], 0.9, 0.0, False) for i, c in enumerate("abcd", 1)]
    for raw, want in (("[3, 1, 1, 9]", "cabd"), ("nada", "abcd"), ("[]", "abcd"), ("ok [2]", "bacd")):
        order = spark.createDataFrame([("t", 1, raw)], "tenant_id string, query_id long, raw string")
        out = fusion.rerank_apply(candidates(spark, rows), order).orderBy("new_rank").collect()
        assert "".join(x["chunk_id"] for x in out) == want


def test_budget_keeps_a_prefix_and_cuts_the_first(spark):
    q = ask(spark, "x" * 33)
    rows = [("t", 0, 1, "A" * 330), ("t", 0, 2, "B" * 3300), ("t", 0, 3, "C" * 3)]
    blocks = spark.createDataFrame(rows, "tenant_id string, query_id long, source_no int, block string")
    options = replace(DEFAULTS, system_chars=330, context_tokens=1000, answer_tokens=400)
    row = context.fit_context(blocks, q, None, options).first()
    assert (row["available_tokens"], row["kept_chunks"], row["dropped_chunks"]) == (950 - 400 - 190, 1, 2)
    assert row["truncated_first"] is False and row["estimated_prompt_tokens"] == 190 + 101
    big = spark.createDataFrame([("t", 0, 1, "Uma frase. " * 300)], blocks.schema)
    kept = context.fit_blocks(big, q, options).first()
    assert kept["truncated_first"] and kept["kept_block"].endswith("frase.\n[trecho cortado para caber no contexto]")
    assert len(kept["kept_block"]) < 360 * 3.3 + 50


def test_router_and_planner(spark):
    q = ask(spark, "O que diz a RDC 67?", "Quais normas tratam disso?", "Definição de água", "A norma está vigente?", "O que diz o art. 5?", "O que é? E quando?")
    got = {x["query_id"]: x for x in planning.plan_queries(q).collect()}
    assert [got[i]["category"] for i in range(6)] == ["exact_term", "relationship", "conceptual", "validity", "article", "multi_question"]
    assert got[0]["use_graph"] is False and got[0]["reason"] == "literal_ref+exact_term"
    assert got[1]["reason"] == "multi_hop+relationship" and got[3]["use_graph"]
    off = planning.plan_queries(q, kag_enabled=False).filter("use_graph").count()
    assert off == 0


def test_rewrites(spark):
    q = ask(spark, "o que diz a rdc 67/07 agora", "lei 5", "e o de a", "portaria 344/1998")
    got = [(x["expand_refs"], x["drop_stopwords"]) for x in planning.rewrite_queries(q).orderBy("query_id").collect()]
    assert got[0] == ("o que diz a rdc 67/07 agora RDC 67/2007", "diz rdc 67 07 agora") or got[0][0].split()[-1] == "67/2007"
    assert got[1][0] == "lei 5 LEI"
    assert got[2][1] == "e o de a"
    assert got[3][0] == "portaria 344/1998 PORTARIA 344/98"


def test_repair_loop_stops(spark):
    """Questions without evidence are asked again at most twice, never in the same words."""
    chunks = r.index_chunks(
        corpus(spark).withColumns({"filename": F.lit("f.md"), "page": F.lit(1), "chunk": F.lit(1), "article": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "body": F.col("text")})
    )
    empty = spark.createDataFrame([], "tenant_id string, edge_id string, document_id string, relation string, source_span string, validation_status string, source_id string, target_id string, source_norm string, target_norm string")
    alias = spark.createDataFrame([], "tenant_id string, entity_id string, alias_normalized string")
    st = r.Store(chunks, lexical.inverted_index(lexical.chunk_tokens(chunks)), empty, None, alias)
    q = ask(spark, TEXTS[2][1], "zzz qqq www", "o zzz lei 9 yyy")
    got = {x["query_id"]: x for x in ev.repair_loop(st, q).collect()}
    assert (got[0]["attempts"], got[0]["stop_reason"]) == (0, "evidence_sufficient")
    assert (got[1]["attempts"], got[1]["stop_reason"]) == (1, "rewrite_exhausted")
    assert got[1]["query_used"] == "zzz qqq www regulamentacao documento normativo"
    assert (got[2]["attempts"], got[2]["stop_reason"]) == (2, "max_retries_reached")
    assert got[2]["query_used"] == "zzz lei yyy"  # lone digits and stopwords go
    assert all(x.startswith("insufficient_evidence:no_chunks_selected") for x in got[1]["reasons"])


def test_graph_chunks_take_two_per_edge_and_skip_seen(spark):
    chunks = spark.createDataFrame([("t", "d", f"c{i}", i, f"Art. {i}") for i in range(1, 7)], "tenant_id string, document_id string, chunk_id string, chunk int, article string")
    edges = spark.createDataFrame([("t", 1, "d", "Art. 3", 1), ("t", 1, "d", "Art. 3", 2), ("t", 1, "d", None, 3)], "tenant_id string, query_id long, document_id string, source_span string, edge_rank int")
    out = graph.graph_to_chunks(edges, chunks).orderBy("graph_rank").collect()
    assert [x["chunk_id"] for x in out] == ["c3", "c1", "c2", "c4", "c5", "c6"]


def test_names_containing_agrees_with_all_pairs(spark):
    names = ["controle de qualidade", "pop", "agua purificada", "qualidade total", "rdc 67/2007"]
    words = ["qualidade", "agua", "67/", "xyz", "pop", "ade"]
    n = spark.createDataFrame([("t", str(i), x) for i, x in enumerate(names)], "tenant_id string, id string, name string")
    q = spark.createDataFrame([("t", 1, x) for x in words], "tenant_id string, query_id long, word string")
    got = {(x["word"], x["id"]) for x in graph.names_containing(n, q).collect()}
    assert got == {(a, str(i)) for i, b in enumerate(names) for a in words if a in b}


def test_gold_documents_agree_with_all_pairs(spark, sf):
    import duckdb

    want = duckdb.sql(f"select count(*) from '{sf}/documents.parquet' d, '{sf}/benchmark.parquet' b where contains(d.text, b.text)").fetchall()[0][0]
    assert r.gold_documents(spark, sf).count() == want > 0


def test_near_duplicate_chunks_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(12):
        terms = [f"w{x}" for x in rng.choice(60, int(rng.integers(1, 30)), replace=False)]
        for copy in range(4):
            kept = [t for t in terms if rng.random() > 0.04] + ([f"x{base}{copy}"] if rng.random() < 0.3 else [])
            rows.append((f"t{base % 2}", f"c{base}-{copy}", kept + kept[:1]))
    rows += [("t0", "e1", []), ("t0", "e2", [])] + [("t0", f"same{k}", ["a", "b"]) for k in range(50)]
    df = spark.createDataFrame(rows, "tenant_id string, chunk_id string, tokens array<string>")
    classes = {}
    for t, c, terms in rows:
        if terms:
            key = (t, frozenset(terms))
            classes[key] = min(classes.get(key, c), c)
    ids = sorted((t, c, s) for (t, s), c in classes.items())
    want = {
        (t, a, b): round(len(x & y) / len(x | y), 6)
        for i, (t, a, x) in enumerate(ids) for u, b, y in ids[i + 1 :] if t == u and len(x & y) / len(x | y) >= 0.9
    }
    got = {(x["tenant_id"], x["left_id"], x["right_id"]): x["similarity"] for x in neighbours.near_duplicate_chunks(df).collect()}
    assert got == want and len(want) > 3
    members = {x["chunk_id"]: x["representative"] for x in neighbours.class_members(df).collect()}
    assert members == {c: classes[t, frozenset(s)] for t, c, s in rows if s}


def test_cells_keep_tenants_with_any_name(spark):
    rng = np.random.default_rng(3)
    names = ["a#b", "a", "#", "3#a"]
    rows = [(t, f"{t}:{i}", [float(x) for x in rng.normal(size=4)]) for t in names for i in range(30)]
    stored = spark.createDataFrame(rows, "tenant_id string, chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(t, 1, rows[0][2]) for t in names], "tenant_id string, query_id long, embedding array<float>")
    got = vectors.ann_topk(stored, asked, 3, cells=4, probes=4).collect()
    assert {r["tenant_id"] for r in got} == set(names) and len(got) == 12
    exact = vectors.cosine_topk(stored, asked, k=3).collect()
    assert {(r["tenant_id"], r["chunk_id"]) for r in got} == {(r["tenant_id"], r["chunk_id"]) for r in exact}


def test_embedding_sends_only_terms_to_python(spark):
    df = spark.createDataFrame([("a b a", "x"), (None, "y")], "text string, other string")
    out = vectors.embed_chunks(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    got = {r["other"]: r["embedding"] for r in out.collect()}
    assert sum(map(abs, got["x"])) > 0 and got["y"] == [0.0] * vectors.DIM


def test_snapshot_derives_metadata_once(spark, sf, monkeypatch):
    from corpusloom.operators import prepare

    calls, whole = [], prepare.document_metadata
    monkeypatch.setattr(prepare, "document_metadata", lambda *a, **k: calls.append(a) or whole(*a, **k))
    st = r.build_store(spark, sf)
    assert len(calls) == 1 and st.chunks.count() > 0


def test_snapshot_stores_only_what_is_asked_for(spark, sf):
    st = r.Snapshot(spark, sf)
    found = st.vectors
    assert st.has("meta") and not any(st.has(p) for p in ("chunks", "terms", "index", "topics", "edges", "described"))
    slim = st.terms
    assert not st.has("chunks")
    whole = st.chunks
    assert found.exceptAll(whole.select(*found.columns)).isEmpty() and slim.exceptAll(whole.select(*slim.columns)).isEmpty()
    assert st.described.columns == [c for c in whole.columns if c not in r.INDEXED]
    assert sorted(r.Snapshot(spark, sf).described.columns) == sorted(st.described.columns)


def test_audits_cut_only_the_documents_that_answers_cite(spark, sf):
    from corpusloom.plans import workload as w

    mine = r.cited_chunks(spark, sf)
    whole = r.Snapshot(spark, sf).described.select(*mine.columns)
    cited = w.answers(spark, sf).select("tenant_id", "document_id").distinct()
    meant = whole.join(cited, ["tenant_id", "document_id"], "left_semi").select(*mine.columns)
    assert mine.count() == meant.count() < whole.count() and mine.exceptAll(meant).isEmpty()


def test_search_by_words_stores_blocks_and_no_terms(spark, sf):
    st = r.Snapshot(spark, sf)
    packs = st.packs.packs
    assert st.has("meta") and not any(st.has(p) for p in ("terms", "chunks", "described", "index"))
    terms = {tuple(row) for row in st.terms.select("tenant_id", "chunk_id", F.size("tokens")).collect()}
    held = packs.select("tenant_id", F.explode(F.arrays_zip("chunks", "lens")).alias("c")).select("tenant_id", "c.chunks", "c.lens")
    assert {tuple(row) for row in held.collect()} == {row for row in terms if row[2] > 0}


def test_large_blocks_lie_in_small_row_groups(spark):
    import pyarrow.parquet as pq
    from corpusloom.operators import packed

    rows = spark.range(70_000, numPartitions=1).select(
        F.lit("t").alias("tenant_id"), F.lit("d").alias("document_id"), F.col("id").cast("string").alias("chunk_id"),
        F.array(F.lit("a")).alias("tokens"), F.lit(1).alias("doc_len"),
    )
    packs = packed.stored_packs(rows)
    files = [pq.ParquetFile(f.removeprefix("file:").removeprefix("//")).metadata for f in packs.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == packs.count() > packed.GROUP >= max(groups)


def test_snapshot_stores_no_text_twice(spark, sf):
    from corpusloom.plans import ingestion as ing

    st = r.Snapshot(spark, sf)
    chunks = st.described
    want = ing.indexed_chunks(spark, sf)
    assert want.select("chunk_id", "text", "body").exceptAll(chunks.select("chunk_id", "text", "body")).isEmpty()
    stored = {name for f in chunks.inputFiles() for name in spark.read.parquet(f).columns}
    assert "text" in stored and "body" not in stored
    heads = ing.metadata(spark, sf).select("tenant_id", "document_id", "head_text")
    kept = st.meta.where("head_text is not null")
    assert 0 < kept.count() < heads.count()
    whole = r.topics_of(heads)
    assert whole.exceptAll(st.topics.select(*whole.columns)).isEmpty() and st.topics.exceptAll(whole).isEmpty()


def test_gold_documents_of_short_and_long_passages(spark, tmp_path):
    docs = [(1, "um dois tres quatro cinco seis", "s"), (2, "zero um dois", "s"), (3, "um doisx", "s"), (4, "um  dois tres quatro cinco", "s"), (5, None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "um dois tres quatro cinco"), (2, "um dois"), (3, " "), (4, "nada"), (5, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((x["query_id"], x["gold"]) for x in r.gold_documents(spark, str(tmp_path)).collect())
    assert got == [(1, "doc1.md"), (2, "doc1.md"), (2, "doc2.md"), (2, "doc4.md")]


def test_near_duplicate_chunks_move_only_hashes_of_rare_terms(spark):
    common = [f"c{i}" for i in range(40)]
    rows = [("t" if i % 2 else "u", f"k{i:03d}", [*common, f"r{i // 4}", *(f"x{i}" for _ in range(i % 3))]) for i in range(200)]
    rows += [("t", "one", ["a"]), ("t", "two", ["a", "a"]), ("u", "none", [])]
    df = spark.createDataFrame(rows, "tenant_id string, chunk_id string, tokens array<string>")
    classes = neighbours.term_classes(df).select("tenant_id", F.col("representative").alias("id"), "terms")
    keys = neighbours.rarest_keys(classes.withColumn("no", F.monotonically_increasing_id()), 0.9)
    sizes = {(x["n"], len(x["keys"])) for x in keys.collect()}
    assert sizes <= {(n, n - math.ceil(n * 0.9 - 1e-9) + 1) for n in range(1, 60)} and max(s[1] for s in sizes) < 7
    sets = {(t, c): set(k) for t, c, k in rows if k}
    first = {}
    for (t, c), k in sorted(sets.items()):
        first.setdefault((t, frozenset(k)), c)
    want = {
        (t, min(c, e), max(c, e)) for (t, k), c in first.items() for (s, o), e in first.items()
        if t == s and c < e and len(k & o) / len(k | o) >= 0.9
    }
    assert {(x["tenant_id"], x["left_id"], x["right_id"]) for x in neighbours.near_duplicate_chunks(df).collect()} == want != set()


def test_rankings_are_stored_before_chunks_meet_them(spark, sf):
    st, q = r.store(spark, sf), w.questions(spark, sf).limit(20)
    lists = r.ranked_lists(st, q)
    plan = r.fuse_lists(st, q, lists)._jdf.queryExecution().optimizedPlan().toString()
    assert "rrf_score" in plan and "share" not in plan


def test_sweep_drops_its_blocks_before_it_searches(spark, sf):
    from corpusloom.operators import evaluate
    from corpusloom.session import exists, recorded_tables

    r.store(spark, sf).whole()
    with recorded_tables() as paths:
        out = ev.parameter_sweep(spark, sf)
    gone = [p for p in paths if not exists(spark, p)]
    assert len(gone) == 1 and out.count() == len(evaluate.build_grid())

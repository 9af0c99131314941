"""Registered queries: lexical index, vectors, fusion, context, planning, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS
from corpusloom.functions import text as T
from corpusloom.operators import context, evaluate, fusion, lexical, neighbours, planning, vectors
from corpusloom.plans import evaluation as ev
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w
from corpusloom.plans.registry import query
from corpusloom.session import written

TQ = ["tenant_id", "query_id"]


def _index(spark, d):
    return r.store(spark, d).index


def _asked(spark, d):
    return vectors.embed_chunks(w.questions(spark, d), "question")


# ------------------------------------------------------------------ lexical


@query
def bm25_postings(spark, d):
    return _index(spark, d).postings.select("chunk_id", "term", "tf")


@query
def bm25_corpus_stats(spark, d):
    index = _index(spark, d)
    return index.frequencies.join(index.totals.withColumn("avg_len", F.round("avg_len", 6)), "tenant_id")


@query
def bm25_search(spark, d):
    hits = lexical.bm25_search(r.store(spark, d).searched, w.questions(spark, d))
    return hits.select(*TQ, "chunk_id", "bm25_score", "bm25_rank")


@query
def lexical_score(spark, d):
    hits = lexical.lexical_score(lexical.bm25_search(r.store(spark, d).searched, w.questions(spark, d)))
    return hits.select(*TQ, "chunk_id", F.round("lexical_score", 6).alias("lexical_score"))


@query
def contains_any_token(spark, d):
    refs = T.with_reference_tokens(w.questions(spark, d), "question")
    wanted = refs.select("tenant_id", F.explode("refs").alias("term")).distinct()
    return lexical.contains_any_token(_index(spark, d), wanted).select("tenant_id", "chunk_id")


@query
def index_size(spark, d):
    return lexical.index_size(_index(spark, d))


# ------------------------------------------------------------------ vectors


def _label_queries(spark, d):
    """The mean vector of each label asks, in the one tenant of the vector table."""
    spread = w.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = spread.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select(
        F.lit("vectors").alias("tenant_id"),
        F.col("label").cast("long").alias("query_id"),
        F.transform("v", lambda s: s["x"]).alias("embedding"),
    )


def _vectors(spark, d):
    return w.table(spark, d, "embeddings").select(
        F.lit("vectors").alias("tenant_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label"
    )


@query
def cosine_topk(spark, d):
    return vectors.cosine_topk(_vectors(spark, d), _label_queries(spark, d)).select(
        "query_id", "chunk_id", "score", "vector_rank"
    )


@query
def cosine_topk_chunks(spark, d):
    return vectors.cosine_topk(r.store(spark, d).vectors, _asked(spark, d)).select(
        *TQ, "chunk_id", "score", "vector_rank"
    )


@query
def ann_topk(spark, d):
    hits = vectors.ann_topk(_vectors(spark, d), _label_queries(spark, d), DEFAULTS.candidates)
    return hits.select("query_id", "chunk_id", "score", "vector_rank")


@query
def cosine_pairs(spark, d):
    pairs = _vectors(spark, d).join(
        _label_queries(spark, d).select(F.col("query_id").alias("label"), F.col("embedding").alias("mean")), "label"
    )
    return vectors.cosine_pairs(pairs, "embedding", "mean").select("chunk_id", "label", "cosine")


def _bm25(spark, d):
    return lexical.bm25_search(r.store(spark, d).searched, w.questions(spark, d))


@query
def score_lexical_only(spark, d):
    chunks, asked = r.store(spark, d).chunks, _asked(spark, d)
    near = vectors.cosine_topk(chunks, asked)
    return vectors.score_lexical_only(_bm25(spark, d), near, chunks, asked)


@query
def embed_chunks(spark, d):
    out = vectors.embed_chunks(w.table(spark, d, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query
def embedding_model_guard(spark, d):
    stored = r.store(spark, d).chunks.withColumn(
        "embedding_model",
        F.when((F.col("tenant_id") == "src7") & (F.col("page") == 2), "other-64").otherwise(F.col("embedding_model")),
    )
    return vectors.embedding_model_guard(stored)


# ------------------------------------------------------------------ fusion


def _fused(spark, d):
    st, asked, q = r.store(spark, d), _asked(spark, d), w.questions(spark, d)
    near = vectors.cosine_topk(st.chunks, asked)
    words = vectors.with_cosine(written(lexical.lexical_score(_bm25(spark, d))), st.chunks, asked)
    _, found = r.graph_candidates(st, q)
    return fusion.rrf_fuse(near, words, found, st.chunks)


@query
def rrf_fuse(spark, d):
    fused = _fused(spark, d)
    return fused.select(*TQ, "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "vector_score",
                        F.round("lexical_score", 6).alias("lexical_score"), "rank")


def _candidates(spark, d):
    return r.candidates(r.store(spark, d), w.questions(spark, d))


@query
def exact_reference(spark, d):
    return _candidates(spark, d).select(*TQ, "chunk_id", "exact_reference")


@query
def passes_relevance(spark, d):
    return _candidates(spark, d).select(*TQ, "chunk_id", fusion.passes_relevance().alias("passes"))


def _orders(spark, d):
    """A model's ranking text for each question, some of it unusable."""
    q = F.col("query_id")
    raw = (
        F.when(q % 4 == 0, "Ordem: [3, 1, 2, 2, 99]")
        .when(q % 4 == 1, F.concat(F.lit("["), (q % 20 + 1).cast("string"), F.lit("]")))
        .when(q % 4 == 2, "sem ordem")
        .otherwise("[0, 5,4]")
    )
    return w.questions(spark, d).select(*TQ, raw.alias("raw"))


@query
def rerank_apply(spark, d):
    ranked = fusion.rerank_apply(_fused(spark, d), _orders(spark, d))
    return ranked.select(*TQ, "chunk_id", "rank", "new_rank")


@query
def dedup_candidates(spark, d):
    return fusion.dedup_candidates(_candidates(spark, d)).select(*TQ, "chunk_id")


@query
def near_duplicate_chunks(spark, d):
    return neighbours.near_duplicate_chunks(r.store(spark, d).terms.select("tenant_id", "chunk_id", "tokens"))


@query
def class_members(spark, d):
    """The class of every chunk, whose representatives ``near_duplicate_chunks`` pairs."""
    return neighbours.class_members(r.store(spark, d).terms.select("tenant_id", "chunk_id", "tokens"))


def _selected(spark, d):
    return r.hybrid_retrieve(r.store(spark, d), w.questions(spark, d))


@query
def select_context(spark, d):
    return _selected(spark, d).select(*TQ, "source_no", "chunk_id")


@query
def hybrid_retrieve(spark, d):
    return _selected(spark, d).select(
        *TQ, "source_no", "chunk_id", "filename", "vector_score",
        F.round("lexical_score", 6).alias("lexical_score"), "exact_reference",
    )


@query
def hybrid_retrieve_reranked(spark, d):
    """Retrieval whose candidates a reranking model has put in a new order before the selection."""
    st, q = r.store(spark, d), w.questions(spark, d)
    return r.hybrid_retrieve(st, q, orders=_orders(spark, d)).select(*TQ, "source_no", "chunk_id")


@query
def source_projection(spark, d):
    return fusion.source_projection(_selected(spark, d))


@query
def context_blocks(spark, d):
    return context.joined_context(context.context_blocks(_selected(spark, d)))


@query
def fit_context(spark, d):
    """Budget of every question with a small window, so that blocks get dropped and cut."""
    from dataclasses import replace

    from corpusloom.operators import graph

    st, q = r.store(spark, d), w.questions(spark, d)
    options = replace(DEFAULTS, context_tokens=2048)
    blocks = context.context_blocks(r.hybrid_retrieve(st, q))
    hits, _ = r.graph_candidates(st, q)
    edges = st.edges.select("tenant_id", "edge_id", "source_name", "relation", "target_name", "filename", "validation_status")
    shown = graph.relation_prompt_lines(
        hits.select(*TQ, "edge_id", "edge_rank").join(edges, ["tenant_id", "edge_id"])
    )
    return context.fit_context(blocks, q, context.relation_blocks(shown), options)


@query
def early_exit(spark, d):
    """The questions, plus the same ones asked in a tenant that holds nothing."""
    st, q = r.store(spark, d), w.questions(spark, d)
    nobody = w.table(spark, d, "benchmark").select(
        F.lit("vazio").alias("tenant_id"), F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
    return context.early_exit(q.unionByName(nobody), st.chunks, r.hybrid_retrieve(st, q))


# ------------------------------------------------------------------ planning


@query
def route_queries(spark, d):
    return planning.route_queries(w.questions(spark, d)).drop("question")


@query
def classify_queries(spark, d):
    return planning.classify_queries(w.questions(spark, d)).drop("question")


@query
def plan_queries(spark, d):
    return planning.plan_queries(w.questions(spark, d)).drop("question")


@query
def rewrite_queries(spark, d):
    return planning.rewrite_queries(w.questions(spark, d)).drop("question")


def _literal(q):
    return planning.classify_queries(q).withColumn(
        "literal_ref", F.col("category").isin("article", "exact_term")
    )


@query
def assess_evidence(spark, d):
    q = w.questions(spark, d)
    out = planning.assess_evidence(_literal(q), _selected(spark, d), min_chunks=2, require_exact=True)
    return out.withColumn("gaps", F.array_join("gaps", ","))


@query
def repair_loop(spark, d):
    out = ev.repair_loop(r.store(spark, d), w.questions(spark, d))
    return out.select(*TQ, "attempts", "query_used", F.array_join("reasons", ";").alias("reasons"), "selected_count", "sufficient", "stop_reason")


@query
def merge_document_lists(spark, d):
    st, asked = r.store(spark, d), _asked(spark, d)
    names = st.chunks.select("tenant_id", "chunk_id", F.upper("filename").alias("document"))
    words = _bm25(spark, d).select(*TQ, "chunk_id", F.col("bm25_rank").alias("rank")).join(
        st.chunks.select("tenant_id", "chunk_id", F.col("filename").alias("document")), ["tenant_id", "chunk_id"]
    )
    near = vectors.cosine_topk(st.chunks, asked).select(*TQ, "chunk_id", F.col("vector_rank").alias("rank"))
    return planning.merge_document_lists(
        words.select(*TQ, "rank", "document"),
        near.join(names, ["tenant_id", "chunk_id"]).select(*TQ, "rank", "document"),
    )


@query
def query_trace(spark, d):
    st, q = r.store(spark, d), w.questions(spark, d)
    selected = written(r.hybrid_retrieve(st, q).drop("tokens", "text"))
    assessed = planning.assess_evidence(q, selected)
    return planning.query_trace(planning.plan_queries(q), selected, assessed)


# ------------------------------------------------------------------ evaluation


def _metrics(spark, d):
    return ev.bm25_metrics(spark, d)


@query
def normalize_cases(spark, d):
    out = evaluate.normalize_cases(ev.cases(spark, d))
    lists = ("expected_document_ids", "expected_evidence_ids", "expected_keywords")
    return out.select(
        *[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in out.columns]
    )


@query
def recall_at_k(spark, d):
    return _metrics(spark, d).select(*TQ, "recall")


@query
def precision_at_k(spark, d):
    return _metrics(spark, d).select(*TQ, "precision")


@query
def hit_rate_at_k(spark, d):
    return _metrics(spark, d).select(*TQ, "hit_rate")


@query
def mrr(spark, d):
    return _metrics(spark, d).select(*TQ, "mrr")


@query
def ndcg_at_k(spark, d):
    return _metrics(spark, d).select(*TQ, "ndcg")


@query
def ablation(spark, d):
    return evaluate.variant_summary(ev.ablation(spark, d)).drop("p50", "p95", "mean")


@query
def variant_summary(spark, d):
    return evaluate.variant_summary(ev.timed_outcomes(spark, d))


@query
def compare_variants(spark, d):
    return evaluate.compare_variants(evaluate.variant_summary(ev.timed_outcomes(spark, d)))


@query
def parameter_sweep(spark, d):
    return ev.parameter_sweep(spark, d)

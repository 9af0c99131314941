"""Evaluation jobs: metrics, repair rounds, ablation, parameter sweep."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.operators import chunking, evaluate, fusion, lexical, planning
from corpusloom.plans import ingestion as ing
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w
from corpusloom.session import drop_tables, recorded_tables, written

TQ = ["tenant_id", "query_id"]


def ranked_documents(hits: DataFrame, documents: DataFrame, rank: str) -> DataFrame:
    """The file names of a ranking's chunks; ``documents`` has one row per document."""
    names = documents.select("tenant_id", "document_id", F.col("filename").alias("document"))
    return hits.select(*TQ, "document_id", F.col(rank).alias("rank")).join(
        names, ["tenant_id", "document_id"]
    ).select(*TQ, "rank", "document")


def bm25_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search of every question, judged by the documents holding its passage."""
    st, q = r.store(spark, sf_dir), w.questions(spark, sf_dir)
    hits = lexical.bm25_search(st.searched, q)
    retrieved = ranked_documents(hits, st.meta, "bm25_rank")
    return evaluate.retrieval_metrics(q, retrieved, r.gold_documents(spark, sf_dir))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cases in their loose input form, one per benchmark passage."""
    i = F.col("item_id")
    none = F.lit(None)
    return w.table(spark, sf_dir, "benchmark").select(
        F.concat(
            F.when(i % 5 == 0, "multi-").when(i % 5 == 1, "recusa-").when(i % 5 == 2, "art-").otherwise("q-"),
            i.cast("string"),
        ).alias("id"),
        F.col("text").alias("question"),
        F.when(i % 3 == 0, F.lit(False)).when(i % 3 == 1, F.lit(True)).alias("should_answer"),
        F.when(i % 2 == 0, F.concat(F.lit("doc"), i.cast("string"), F.lit(".md"))).alias("expected_document"),
        F.when(i % 4 == 2, F.array(F.lit("a.md"), F.lit("b.md"))).alias("expected_document_ids"),
        none.cast("array<string>").alias("expected_evidence_ids"),
        F.when(i % 7 == 0, "").alias("expected_article"),
        F.when(i % 2 == 1, F.slice(F.split("text", " "), 1, 2)).alias("expected_keywords"),
        none.cast("string").alias("reference_answer"),
        F.when(i % 8 == 4, "validity").alias("category"),
        none.cast("string").alias("difficulty"),
        F.when(i % 6 == 0, True).alias("requires_current_validity"),
        F.when(i % 9 == 0, "approved").alias("review_status"),
    )


def repair_loop(st: r.Store | r.Snapshot, questions: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Retrieve, assess, and ask again what stayed without evidence, a few rounds at most.

    Each round is one bulk job over the questions still open; its result is
    stored so that the next round starts from a table.
    """
    literal = planning.classify_queries(questions).select(
        *TQ, "question", F.col("category").isin("article", "exact_term").alias("literal_ref")
    )
    pending = literal.withColumns(
        {
            "query_used": F.col("question"),
            "tried": F.array("question"),
            "reasons": F.array().cast("array<string>"),
        }
    )
    done = None
    for attempt in range(options.max_retries + 1):
        asked = pending.select(*TQ, F.col("query_used").alias("question"))
        assessed = planning.assess_evidence(
            pending.select(*TQ, "literal_ref"), r.hybrid_retrieve(st, asked, options=options)
        )
        state = written(
            pending.join(assessed.select(*TQ, "selected_count", "gaps", "sufficient"), TQ)
            .withColumn("attempts", F.lit(attempt))
            .withColumn("_next", planning.next_query(attempt))
        )
        last = attempt == options.max_retries
        stop = (
            F.when(F.col("sufficient"), "evidence_sufficient")
            .when(F.lit(last), "max_retries_reached")
            .when(F.col("_next").isNull(), "rewrite_exhausted")
        )
        state = state.withColumn("stop_reason", stop)
        closed = state.filter("stop_reason IS NOT NULL").select(
            *TQ, "attempts", "query_used", "reasons", "selected_count", "sufficient", "stop_reason"
        )
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        gaps = F.array_join("gaps", ",")
        pending = state.filter("stop_reason IS NULL").select(
            *TQ,
            "question",
            "literal_ref",
            F.col("_next").alias("query_used"),
            F.concat("tried", F.array("_next")).alias("tried"),
            F.concat(
                "reasons", F.array(F.concat(F.lit("insufficient_evidence:"), gaps))
            ).alias("reasons"),
        )
        if pending.isEmpty():
            break
    return done


VARIANTS = (("vector", False, False), ("hybrid", True, False), ("hybrid_kag", True, True))


def ablation(spark: SparkSession, sf_dir: str, options: Options = DEFAULTS) -> DataFrame:
    """Outcome of every question with vectors, with words added, with the graph added.

    The three rankings are worked out once and stored; variants only fuse them.
    """
    st, q = r.store(spark, sf_dir), w.questions(spark, sf_dir)
    gold = r.gold_documents(spark, sf_dir)
    lists = r.ranked_lists(st, q, options=options)
    near, words, graph_found = written(lists.near), written(lists.words), written(lists.found)
    found = None
    for position, (name, use_bm25, use_graph) in enumerate(VARIANTS):
        mine = r.Lists(near, words if use_bm25 else None, graph_found if use_graph else None)
        selected = fusion.select_context(r.fuse_lists(st, q, mine, options), options).select(
            F.lit(position).alias("position"), F.lit(name).alias("variant"),
            *TQ, F.col("source_no").alias("rank"), F.col("filename").alias("document"),
        )
        found = selected if found is None else found.unionByName(selected)
    found = written(found)
    out = None
    for position, (name, _, _) in enumerate(VARIANTS):
        mine = found.filter(F.col("position") == position)
        metrics = evaluate.retrieval_metrics(q, mine.select(*TQ, "rank", "document"), gold)
        counts = mine.groupBy(*TQ).agg(F.count("*").alias("selected_count"))
        part = metrics.join(counts, TQ, "left").select(
            F.lit(position).alias("position"),
            F.lit(name).alias("variant"),
            *TQ,
            F.lit(True).alias("should_answer"),
            (F.col("hit_rate") > 0).alias("document_hit_at_5"),
            F.col("mrr").alias("reciprocal_rank"),
            F.coalesce("selected_count", F.lit(0)).alias("selected_count"),
            F.lit(0).alias("retrieval_ms"),
            F.lit(None).cast("string").alias("error"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def timed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of three variants read off the event log: kind of event and its value."""
    e = F.col("event_id")
    return w.table(spark, sf_dir, "events").select(
        (e % 3).cast("int").alias("position"),
        F.element_at(F.array(*[F.lit(v[0]) for v in VARIANTS]), (e % 3 + 1).cast("int")).alias("variant"),
        (F.col("event_type") != "signup").alias("should_answer"),
        F.when(F.col("event_type") != "view", F.col("value") > 20).alias("document_hit_at_5"),
        F.when(F.col("event_type") != "view", F.round(1.0 / (e % 5 + 1), 6)).alias("reciprocal_rank"),
        (e % 5).cast("int").alias("selected_count"),
        F.floor(F.col("value") * 10).cast("long").alias("retrieval_ms"),
        F.when(F.col("event_type") == "error", "timeout").alias("error"),
    )


def parameter_sweep(spark: SparkSession, sf_dir: str, options: Options = DEFAULTS) -> DataFrame:
    """Chunks made per (size, overlap) and questions with relevant candidates per threshold.

    Texts are split once per (size, overlap); every threshold is judged in the
    same pass over the candidates of the stored snapshot's own chunking.
    """
    grid = evaluate.build_grid()
    lines = chunking.page_lines(w.corpus_pages(spark, sf_dir))
    with recorded_tables() as cut:
        blocks = written(chunking.segment_blocks(chunking.carry_context(chunking.classify_lines(lines))))
    made = None
    for size, overlap in sorted({(c, o) for c, o, _, _ in grid}):
        cell = replace(options, chunk_chars=size, overlap_chars=overlap)
        chunks = chunking.assemble_chunks(chunking.split_oversized(blocks, cell))
        count = chunks.agg(F.count("*").alias("chunks"), F.max(F.length("body")).alias("longest")).select(
            F.lit(size).alias("chunk_chars"), F.lit(overlap).alias("chunk_overlap_chars"), "chunks", "longest"
        )
        made = count if made is None else made.unionByName(count)
    # The blocks have been counted and make room for the search.
    made = written(made)
    drop_tables(spark, cut)
    st, q = r.store(spark, sf_dir), w.questions(spark, sf_dir)
    found = r.candidates(st, q, options=options).select(
        *TQ, "vector_score", "exact_reference", "lexical_score"
    )
    scores = sorted({s for _, _, s, _ in grid})
    flags = [
        F.max(fusion.passes_relevance(replace(options, min_relevance=s)).cast("int")).alias(f"_s{i}")
        for i, s in enumerate(scores)
    ]
    per_question = found.groupBy(*TQ).agg(*flags)
    totals = per_question.agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(scores))])
    judged = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("min_relevance_score"), F.coalesce(f"_s{i}", F.lit(0)).alias("answerable"))
                    for i, s in enumerate(scores)
                ]
            )
        ).alias("j")
    ).select("j.*")
    cells = spark.createDataFrame(
        grid, "chunk_chars int, chunk_overlap_chars int, min_relevance_score double, collection_name string"
    )
    return cells.join(made, ["chunk_chars", "chunk_overlap_chars"]).join(judged, "min_relevance_score")

"""Rank fusion, reference matching, reranking, de-duplication and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import text as T

TQ = ["tenant_id", "query_id"]
KEY = [*TQ, "chunk_id"]


def rrf_fuse(
    vector_hits: DataFrame,
    bm25_hits: DataFrame | None = None,
    graph_hits: DataFrame | None = None,
    stored: DataFrame | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """One row per (question, chunk): summed reciprocal ranks and the scores of each list.

    The vector score comes from the vector list, else from the true ``cosine`` of
    a chunk only BM25 found, else from the graph. Each list holds at most a dozen
    chunks per question.
    """

    def ranked(df: DataFrame, source: int, rank: str, **scores: Column) -> DataFrame:
        none = F.lit(None).cast("double")
        return df.select(
            *KEY,
            F.lit(source).alias("source"),
            (1.0 / (options.rrf_k + F.col(rank))).alias("share"),
            *[scores.get(c, none).alias(c) for c in ("vector", "cosine", "graph", "bm25", "lexical")],
        )

    lists = ranked(vector_hits, 1, "vector_rank", vector=F.col("score"))
    if bm25_hits is not None:
        lists = lists.unionByName(
            ranked(
                bm25_hits,
                2,
                "bm25_rank",
                cosine=F.col("cosine"),
                bm25=F.col("bm25_score"),
                lexical=F.col("lexical_score"),
            )
        )
    if graph_hits is not None:
        lists = lists.unionByName(ranked(graph_hits, 3, "graph_rank", graph=F.col("score")))
    # One exchange by question serves the sums here and every window after.
    fused = lists.repartition(*TQ).groupBy(*KEY).agg(
        F.round(F.sum("share"), 9).alias("rrf_score"),
        F.coalesce(F.max("vector"), F.max("cosine"), F.max("graph"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.max("bm25"), F.lit(0.0)).alias("bm25_score"),
        F.coalesce(F.max("lexical"), F.lit(0.0)).alias("lexical_score"),
        F.min("source").alias("first_list"),
    )
    if stored is not None:  # a chunk missing from the store drops out
        fused = fused.join(stored.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_semi")
    return with_rank(fused)


def with_rank(fused: DataFrame) -> DataFrame:
    """Order of a question's candidates: score, then list of first appearance, then chunk id."""
    w = Window.partitionBy(*TQ).orderBy(F.col("rrf_score").desc(), "first_list", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w))


def describe(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach text and metadata."""
    return fused.join(chunks, ["tenant_id", "chunk_id"])


def exact_reference(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``tokens`` and whether the chunk holds a norm or article the question names."""
    asked = T.with_reference_tokens(questions.select(*TQ, "question"), "question").drop("question")
    joined = candidates.join(asked, TQ)
    if "tokens" not in joined.columns:
        joined = T.with_tokens(joined, "text")
    return (
        joined.withColumn("exact_reference", F.arrays_overlap("refs", "tokens"))
        .withColumn("tokens", F.array_distinct("tokens"))
        .drop("refs")
    )


def passes_relevance(options: Options = DEFAULTS) -> Column:
    """Close enough, or a literal reference with a strong lexical score."""
    return (F.col("vector_score") >= options.min_relevance) | (
        F.col("exact_reference") & (F.col("lexical_score") >= options.lexical_override)
    )


def rerank_apply(candidates: DataFrame, orders: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Apply an order given as text, e.g. ``[3,1,2]``: named first, leftovers after.

    Only the first candidates take part. An unusable order keeps the ranking.
    """
    limit = options.rerank_candidates
    listed = F.from_json(F.regexp_extract("raw", r"(?U)\[[\s\d,\]]+\]", 0), "array<string>")
    named = (
        orders.select(*TQ, F.array_distinct(F.transform(listed, lambda x: x.try_cast("int"))).alias("_o"))
        .select(*TQ, F.posexplode("_o").alias("_new", "rank"))
        .filter("rank IS NOT NULL")
    )
    joined = candidates.filter(F.col("rank") <= limit).join(named, [*TQ, "rank"], "left")
    w = Window.partitionBy(*TQ).orderBy(F.coalesce(F.col("_new"), 1_000_000 + F.col("rank")))
    return joined.withColumn("new_rank", F.row_number().over(w)).drop("_new")


def reranked(candidates: DataFrame, orders: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Candidates in the new order only: what later steps call the rank."""
    return rerank_apply(candidates, orders, options).drop("rank").withColumnRenamed("new_rank", "rank")


def dedup_candidates(candidates: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Keep a candidate unless it repeats one already kept.

    Greedy in rank order, so it folds over the candidates of one question: at
    most three lists of a dozen, gathered with all their columns so that nothing
    is joined back.
    """
    rest = [c for c in candidates.columns if c not in (*TQ, "rank")]
    item = F.struct("rank", *rest)
    listed = candidates.groupBy(*TQ).agg(F.sort_array(F.collect_list(item)).alias("_c"))

    def repeats(kept: Column, new: Column) -> Column:
        def same(old: Column) -> Column:
            overlap = T.jaccard(old["tokens"], new["tokens"])
            near = (old["document_id"] == new["document_id"]) & (
                F.abs(old["chunk"] - new["chunk"]) <= 1
            )
            return (overlap >= options.dedup_similarity) | (
                near & (overlap >= options.adjacent_similarity)
            )

        return F.exists(kept, same)

    kept = F.aggregate(
        "_c",
        F.slice("_c", 1, 0),
        lambda acc, x: F.when(repeats(acc, x), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return listed.select(*TQ, F.explode(kept).alias("k")).select(*TQ, "k.*").select(*candidates.columns)


def select_context(candidates: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Relevant, not repeated, first few; numbered as sources."""
    w = Window.partitionBy(*TQ).orderBy("rank")
    unique = dedup_candidates(candidates.filter(passes_relevance(options)), options)
    return unique.withColumn("source_no", F.row_number().over(w)).filter(
        F.col("source_no") <= options.context_chunks
    )


def source_projection(selected: DataFrame) -> DataFrame:
    """What is shown of a source: rounded scores, an excerpt, defaults."""
    return selected.select(
        *TQ,
        F.col("source_no"),
        F.coalesce("filename", F.lit("documento")).alias("document"),
        "page",
        F.coalesce("chunk", F.lit(0)).alias("chunk"),
        F.bround("vector_score", 4).alias("score"),
        F.bround("lexical_score", 4).alias("lexical_score"),
        F.left("text", F.lit(600)).alias("excerpt"),
        "authority",
        "regulation_number",
        "publication_date",
        "effective_date",
        "status",
        T.status_label(F.col("status")).alias("status_label"),
        "article",
        "section",
        "source_url",
        "document_version",
        F.lit(False).alias("cited"),
    )

"""Retrieval and answer quality, variant comparison, parameter grid."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as T

TQ = ["tenant_id", "query_id"]


def normalize_cases(cases: DataFrame) -> DataFrame:
    """Defaults, gold list from a single gold, inferred category."""
    answer = F.coalesce("should_answer", F.lit(True))
    empty = F.array().cast("array<string>")
    golds = F.coalesce("expected_document_ids", empty)
    single = F.col("expected_document")
    case_id = F.coalesce("id", F.lit(""))
    category = (
        F.when(F.coalesce("category", F.lit("")) != "", F.col("category"))
        .when(case_id.startswith("multi-"), "relationship")
        .when(case_id.startswith("recusa-"), "abstention")
        .when(case_id.startswith("art-") | F.contains(F.lower("question"), F.lit("art.")), "article")
        .when(~answer, "abstention")
        .otherwise("regulatory")
    )

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return cases.select(
        case_id.alias("id"),
        "question",
        answer.alias("should_answer"),
        text("expected_document").alias("expected_document"),
        F.when((F.size(golds) == 0) & (F.coalesce(single, F.lit("")) != ""), F.array(single))
        .otherwise(golds)
        .alias("expected_document_ids"),
        F.coalesce("expected_evidence_ids", empty).alias("expected_evidence_ids"),
        text("expected_article").alias("expected_article"),
        F.coalesce("expected_keywords", empty).alias("expected_keywords"),
        text("reference_answer").alias("reference_answer"),
        category.alias("category"),
        text("difficulty").alias("difficulty"),
        F.coalesce("requires_current_validity", F.lit(False)).alias("requires_current_validity"),
        F.coalesce(text("review_status"), F.lit("seeded_from_dataset_json")).alias("review_status"),
    )


def retrieval_metrics(
    questions: DataFrame, retrieved: DataFrame, gold: DataFrame, k: int = 5
) -> DataFrame:
    """Recall, precision, hit rate, MRR and nDCG of each question; null without gold.

    ``retrieved`` (question, rank, document) is a short ranking; ``gold``
    (question, gold) the expected names. A name matches when the normalized gold
    lies in it. Repeats of a gold document count in precision and gain.
    """
    top = retrieved.filter(F.col("rank") <= k)
    names = gold.distinct()
    matched = (
        top.join(names, TQ)
        .filter(F.contains(T.normalize_text(F.col("document")), T.normalize_text(F.col("gold"))))
        .select(*TQ, "rank", "gold")
    )
    found = matched.groupBy(*TQ).agg(F.countDistinct("gold").alias("found"), F.min("rank").alias("best"))
    gain = (
        matched.select(*TQ, "rank")
        .distinct()
        .groupBy(*TQ)
        .agg(F.count("*").alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    )
    golds = names.groupBy(*TQ).agg(F.count("*").alias("golds"))
    returned = top.groupBy(*TQ).agg(F.count("*").alias("returned"))
    joined = (
        questions.select(*TQ)
        .join(golds, TQ, "left")
        .join(found, TQ, "left")
        .join(gain, TQ, "left")
        .join(returned, TQ, "left")
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("golds"), F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )

    def known(value: Column) -> Column:
        return F.when(F.col("golds").isNotNull(), F.round(value, 6))

    zero = F.lit(0)
    return joined.select(
        *TQ,
        known(F.coalesce("found", zero) / F.col("golds")).alias("recall"),
        known(F.coalesce(F.col("hits") / F.col("returned"), F.lit(0.0))).alias("precision"),
        known(F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"),
        known(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
        known(F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).alias("ndcg"),
    )


def keyword_coverage(answers: DataFrame) -> DataFrame:
    """Share of the expected words that occur in the answer; null without words."""
    answer = T.normalize_text(F.col("answer"))
    staged = answers.withColumn("_answer", answer)
    hits = F.size(
        F.filter("keywords", lambda k: F.contains(F.col("_answer"), T.normalize_text(k)))
    )
    return staged.withColumn(
        "keyword_coverage", F.when(F.size("keywords") > 0, F.round(hits / F.size("keywords"), 3))
    ).drop("_answer")


def detect_abstention(c: Column) -> Column:
    norm = T.normalize_text(c)
    found = F.lit(False)
    for marker in P.ABSTENTION_MARKERS:
        found = found | F.contains(norm, F.lit(marker))
    return found


def _mean(value: Column, digits: int = 2) -> Column:
    return F.round(F.avg(value), digits)


def _nonzero(name: str) -> Column:
    return F.when(F.col("_ok") & (F.col(name) != 0), F.col(name))


def _quantile(value: Column, q: float) -> Column:
    return F.coalesce(F.round(F.percentile(value, F.lit(q)), 2), F.lit(0.0))


def generation_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts, quality rates and latencies of answered cases, in one pass."""
    staged = results.withColumn("_ok", F.col("http_status") == 200)
    ok, ask = F.col("_ok"), F.col("should_answer")
    refused = ok & (F.col("abstained") | ~F.col("grounded"))

    def rate(pool: Column, good: Column) -> Column:
        return F.round(F.avg(F.when(pool, F.when(good, 1.0).otherwise(0.0))), 3)

    latency = F.when(ok, F.col("duration_ms"))
    return staged.groupBy(*by).agg(
        F.count("*").alias("cases_total"),
        F.count_if(ok).alias("cases_ok"),
        F.count_if(~ok).alias("cases_failed"),
        rate(ask & F.col("document_hit_at_5").isNotNull(), F.col("document_hit_at_5")).alias("recall_at_5"),
        F.count_if(ask & F.col("document_hit_at_5").isNotNull()).alias("recall_evaluated"),
        rate(ask & ok & F.col("grounded"), F.col("cited_sources") > 0).alias("citation_precision"),
        rate(ask & ok, F.col("grounded")).alias("grounded_rate"),
        rate(~ask, refused).alias("abstention_accuracy"),
        _mean(F.when(ask, F.col("keyword_coverage")), 3).alias("keyword_coverage"),
        _quantile(latency, 0.50).alias("p50"),
        _quantile(latency, 0.95).alias("p95"),
        _mean(latency).alias("mean"),
        _mean(_nonzero("embed_ms")).alias("embedding_mean"),
        _mean(_nonzero("load_duration_ms")).alias("model_load_mean"),
        _mean(_nonzero("chat_ms")).alias("generation_mean"),
        _mean(_nonzero("tokens_per_second")).alias("tokens_per_second_mean"),
    )


def variant_summary(outcomes: DataFrame) -> DataFrame:
    """Per variant: recall, MRR, sources, latencies, errors."""
    fine = F.col("error").isNull()
    ask = F.col("should_answer") & fine
    hit = F.col("document_hit_at_5")
    latency = F.when(fine, F.col("retrieval_ms"))
    return outcomes.groupBy("position", "variant").agg(
        F.count("*").alias("cases_total"),
        F.count_if(~fine).alias("cases_errored"),
        F.round(F.avg(F.when(ask & hit.isNotNull(), F.when(hit, 1.0).otherwise(0.0))), 3).alias("recall_at_5"),
        F.count_if(ask & hit.isNotNull()).alias("recall_evaluated"),
        _mean(F.when(ask, F.col("reciprocal_rank")), 3).alias("mrr"),
        _mean(F.when(ask, F.col("selected_count"))).alias("selected_mean"),
        _quantile(latency, 0.50).alias("p50"),
        _quantile(latency, 0.95).alias("p95"),
        _mean(latency).alias("mean"),
    )


def compare_variants(summaries: DataFrame) -> DataFrame:
    """Recall difference of each variant to the one before; a handful of rows."""
    w = Window.orderBy("position")
    return (
        summaries.select(
            F.lag("variant").over(w).alias("from_variant"),
            F.col("variant").alias("to_variant"),
            F.round(F.col("recall_at_5") - F.lag("recall_at_5").over(w), 3).alias("recall_delta"),
        )
        .filter("from_variant IS NOT NULL")
    )


# The default grid.
GRID_CHARS = (1400, 1900, 2400)
GRID_OVERLAPS = (200, 285, 400)
GRID_SCORES = (0.35, 0.45, 0.55, 0.65)


def build_grid(
    chars: tuple = GRID_CHARS, overlaps: tuple = GRID_OVERLAPS, scores: tuple = GRID_SCORES
) -> list[tuple[int, int, float, str]]:
    """Cells of the grid; an overlap as long as the chunk is invalid and left out."""
    return [
        (c, o, s, f"sweep_{c}_{o}_{int(s * 100)}")
        for c, o, s in itertools.product(chars, overlaps, scores)
        if o < c
    ]

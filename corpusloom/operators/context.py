"""Context blocks, the token budget, and the early outcome of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T

TQ = ["tenant_id", "query_id"]
# Heading of the relations block.
RELATIONS_TITLE = "[Relações KAG — orientação; confirme sempre pelas Fontes]"


def context_blocks(selected: DataFrame) -> DataFrame:
    """``[Fonte i]`` blocks as retrieved, and their sanitized form for the prompt."""
    blocks = selected.withColumn(
        "block",
        F.concat(F.lit("[Fonte "), F.col("source_no").cast("string"), F.lit("]\n"), F.col("text")),
    )
    return T.with_sanitized(blocks, "block", "clean_block")


def joined_context(blocks: DataFrame) -> DataFrame:
    """The whole sanitized context of each question (a handful of blocks)."""
    ordered = F.sort_array(F.collect_list(F.struct("source_no", "clean_block")))
    return blocks.groupBy(*TQ).agg(
        F.array_join(F.transform(ordered, lambda s: s["clean_block"]), "\n\n").alias("context"),
        F.count("*").cast("int").alias("blocks"),
    )


def _last_index(text: Column, needle: str) -> Column:
    """Zero-based position of the last occurrence, -1 when absent."""
    at = F.locate(needle[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - len(needle) - at + 1).otherwise(-1)


def truncated(text: Column, limit: Column) -> Column:
    """Cut to ``limit`` characters, at a sentence end in the second half if there is one."""
    cut = F.left(text, limit)
    end = F.greatest(_last_index(cut, ". "), _last_index(cut, ".\n"), _last_index(cut, "\n"))
    kept = F.when(end >= limit * 0.5, F.left(cut, end + 1)).otherwise(cut)
    short = F.concat(F.rtrim(kept, F.lit(T.BLANKS)), F.lit(P.TRUNCATION_NOTE))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def relation_blocks(relations: DataFrame) -> DataFrame:
    """One text per question from its edge lines (at most eight)."""
    ordered = F.sort_array(F.collect_list(F.struct("edge_rank", "line")))
    return relations.groupBy(*TQ).agg(
        F.concat(
            F.lit(RELATIONS_TITLE + "\n"),
            F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"),
        ).alias("relations")
    )


def _with_budget(blocks: DataFrame, questions: DataFrame, options: Options) -> DataFrame:
    ratio = options.chars_per_token
    system = -(-options.system_chars * 10 // int(ratio * 10))
    room = int(options.context_tokens * (1 - options.budget_margin)) - options.answer_tokens
    fixed = F.lit(system + options.prompt_overhead) + T.estimate_tokens(F.col("question"), ratio)
    asked = questions.select(*TQ, fixed.alias("fixed")).withColumn(
        "available_tokens", F.greatest(F.lit(room) - F.col("fixed"), F.lit(0))
    )
    w = Window.partitionBy(*TQ).orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    costed = blocks.join(asked, TQ).withColumn("cost", T.estimate_tokens(F.col("block"), ratio) + 1)
    return costed.withColumn("running", F.sum("cost").over(w))


def mark_blocks(blocks: DataFrame, questions: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Which blocks stay: the longest prefix that fits; the first is cut rather than lost.

    Costs are positive, so a block fits exactly when the running sum does.
    """
    costed = _with_budget(blocks, questions, options)
    allowed = F.greatest(F.col("available_tokens"), F.lit(options.min_first_block))
    limit = F.floor(allowed * F.lit(options.chars_per_token)).cast("int")
    fits = F.col("running") <= F.col("available_tokens")
    oversize = (F.col("source_no") == 1) & ~fits
    return costed.withColumns(
        {
            "truncated_first": oversize,
            "kept_block": F.when(fits, F.col("block")).when(oversize, truncated(F.col("block"), limit)),
        }
    )


def fit_blocks(blocks: DataFrame, questions: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The blocks that go into the prompt, as they go."""
    return mark_blocks(blocks, questions, options).filter("kept_block IS NOT NULL")


def fit_context(
    blocks: DataFrame,
    questions: DataFrame,
    relations: DataFrame | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """The budget decision of each question that has blocks."""
    ratio = options.chars_per_token
    kept = F.col("kept_block").isNotNull()
    joined = mark_blocks(blocks, questions, options).groupBy(*TQ).agg(
        F.first("fixed").alias("fixed"),
        F.first("available_tokens").alias("available_tokens"),
        F.sum(F.when(kept, T.estimate_tokens(F.col("kept_block"), ratio) + 1)).alias("used"),
        F.count_if(kept).alias("kept_chunks"),
        F.count_if(~kept).alias("dropped_chunks"),
        F.bool_or("truncated_first").alias("truncated_first"),
    )
    if relations is None:
        joined = joined.withColumn("relations", F.lit(None).cast("string"))
    else:
        joined = joined.join(relations, TQ, "left")
    extra = T.estimate_tokens(F.col("relations"), ratio) + 1
    asked = F.col("relations").isNotNull()
    fits = asked & (F.col("used") + extra <= F.col("available_tokens"))
    return joined.select(
        *TQ,
        F.lit(options.context_tokens).alias("context_tokens"),
        "available_tokens",
        (F.col("fixed") + F.col("used") + F.when(fits, extra).otherwise(0)).alias("estimated_prompt_tokens"),
        "kept_chunks",
        "dropped_chunks",
        "truncated_first",
        (asked & ~fits).alias("relations_dropped"),
    )


def early_exit(questions: DataFrame, chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """``empty_base``, ``no_evidence`` or ``answerable`` for each question."""
    filled = chunks.select("tenant_id").distinct().withColumn("_filled", F.lit(True))
    evident = selected.select(*TQ).distinct().withColumn("_evident", F.lit(True))
    joined = questions.select(*TQ).join(filled, "tenant_id", "left").join(evident, TQ, "left")
    return joined.select(
        *TQ,
        F.when(F.col("_filled").isNull(), "empty_base")
        .when(F.col("_evident").isNull(), "no_evidence")
        .otherwise("answerable")
        .alias("outcome"),
    )

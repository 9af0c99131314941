"""Question routing, planning, rewriting, evidence checks and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T

TQ = ["tenant_id", "query_id"]


def route_queries(questions: DataFrame, kag_enabled: bool = True) -> DataFrame:
    """Which searches a question needs, and why."""
    q = F.col("question")
    multi = q.rlike(P.MULTI_HOP)
    literal = q.rlike(P.LITERAL_REF)
    if kag_enabled:
        reason = F.when(multi, "multi_hop").when(literal, "literal_ref").otherwise("default")
    else:
        reason = F.lit("kag_disabled")
    return (
        questions.withColumn("reason", reason)
        .withColumn("use_vector", F.lit(True))
        .withColumn("use_bm25", F.lit(True))
        .withColumn("use_graph", ~F.col("reason").isin("literal_ref", "kag_disabled"))
    )


def category() -> Column:
    q = F.col("question")
    return (
        F.when(q.rlike(P.PLAN_MULTI), "multi_question")
        .when(q.rlike(P.PLAN_RELATIONSHIP), "relationship")
        .when(q.rlike(P.PLAN_VALIDITY), "validity")
        .when(q.rlike(P.PLAN_ARTICLE), "article")
        .when(q.rlike(P.LITERAL_REF), "exact_term")
        .otherwise("conceptual")
    )


def classify_queries(questions: DataFrame) -> DataFrame:
    c = F.col("category")
    strategy = F.lit(None).cast("string")
    for name, value in P.STRATEGIES.items():
        strategy = F.when(c == name, value).otherwise(strategy)
    return (
        questions.withColumn("category", category())
        .withColumn("strategy", strategy)
        .withColumn(
            "confidence",
            F.when(c.isin("article", "exact_term"), "high").when(c == "conceptual", "low").otherwise("medium"),
        )
    )


def plan_queries(questions: DataFrame, kag_enabled: bool = True) -> DataFrame:
    """Routing adjusted by category, with the combined reason."""
    planned = classify_queries(route_queries(questions, kag_enabled))
    c = F.col("category")
    to_graph = c.isin("relationship", "validity") & F.lit(kag_enabled)
    named = c.isin("article", "exact_term") | to_graph
    return planned.withColumn(
        "reason", F.when(named, F.concat("reason", F.lit("+"), c)).otherwise(F.col("reason"))
    ).withColumn("use_graph", F.when(to_graph, True).otherwise(F.col("use_graph")))


def _unique_words(c: Column) -> Column:
    words = F.filter(F.split(T.squeeze(c), " "), lambda x: x != "")
    return F.array_join(F.array_distinct(words), " ")


def expand_refs(c: Column) -> Column:
    """Question and its norm references with short and long years, each word once.

    References are marked in the text, the text is cut at the marks, and every
    other piece is a reference.
    """
    mark = "\x01"
    pieces = F.split(F.regexp_replace(c, P.REF_EXPAND, f"{mark}$0{mark}"), mark, -1)

    def variants(m: Column) -> Column:
        base = F.concat(F.upper(F.regexp_extract(m, P.REF_EXPAND, 1)), F.lit(" "), F.regexp_extract(m, P.REF_EXPAND, 2))
        year = F.regexp_extract(m, P.REF_EXPAND, 3)
        named = F.concat(base, F.lit("/"), year)
        century = F.when(year.try_cast("int") >= 50, "19").otherwise("20")
        return (
            F.when(F.length(year) == 2, F.concat_ws(" ", named, F.concat(base, F.lit("/"), century, year)))
            .when(F.length(year) == 4, F.concat_ws(" ", named, F.concat(base, F.lit("/"), F.right(year, F.lit(2)))))
            .when(year != "", named)
            .otherwise(base)
        )

    expanded = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, variants(p)).otherwise(p)), ""
    )
    both = F.when(expanded == c, c).otherwise(F.concat(c, F.lit(" "), expanded))
    return _unique_words(both)


def drop_stopwords(c: Column) -> Column:
    folded = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    words = F.filter(
        F.regexp_extract_all(folded, F.lit(r"(?U)(\w+)"), F.lit(1)),
        lambda x: ~x.isin(*P.REWRITE_STOPWORDS) & (F.length(x) > 1),
    )
    kept = F.array_join(words, " ")
    return F.when(kept == "", c).otherwise(kept)


def rewrite_queries(questions: DataFrame) -> DataFrame:
    q = F.col("question")
    return questions.withColumn("expand_refs", expand_refs(q)).withColumn(
        "drop_stopwords", drop_stopwords(q)
    )


def assess_evidence(
    questions: DataFrame, selected: DataFrame, min_chunks: int = 1, require_exact: bool = False
) -> DataFrame:
    """What the selected sources offer each question, and what is missing.

    ``questions`` may carry ``literal_ref``: whether it names a norm or article.
    """
    status = F.coalesce("status", F.lit(P.STATUS_UNVERIFIED))
    found = selected.groupBy(*TQ).agg(
        F.count("*").alias("selected_count"),
        F.bool_or("exact_reference").alias("has_exact_reference"),
        F.count_if(status != P.STATUS_IN_FORCE).alias("unverified_count"),
        F.count_if(status == P.STATUS_IN_FORCE).alias("_in_force"),
    )
    names = [*TQ] + (["literal_ref"] if "literal_ref" in questions.columns else [])
    joined = questions.select(*names).join(found, TQ, "left")
    if "literal_ref" not in names:
        joined = joined.withColumn("literal_ref", F.lit(False))
    n = F.coalesce("selected_count", F.lit(0))
    exact = F.coalesce("has_exact_reference", F.lit(False))
    some = n > 0
    conflict = some & (F.col("unverified_count") > 0) & (F.col("_in_force") > 0)
    few = some & (n < min_chunks)
    unmatched = some & ~few & F.lit(require_exact) & F.col("literal_ref") & ~exact
    # Names of gaps.
    gaps = F.array_compact(
        F.array(
            F.when(~some, "no_chunks_selected"),
            F.when(some & (F.col("unverified_count") > 0), "validity_unverified_in_selection"),
            F.when(conflict, "conflicting_validity_metadata"),
            F.when(few, "below_min_chunks"),
            F.when(unmatched, "literal_ref_without_exact_match"),
        )
    )
    return joined.select(
        *TQ,
        n.alias("selected_count"),
        exact.alias("has_exact_reference"),
        F.coalesce("unverified_count", F.lit(0)).alias("unverified_count"),
        F.coalesce(conflict, F.lit(False)).alias("conflict_suspected"),
        gaps.alias("gaps"),
        (some & ~few & ~unmatched).alias("sufficient"),
    )


def next_query(attempt: int) -> Column:
    """Rewritten text of the next attempt, null when every rewrite was tried.

    ``question`` is the original, ``tried`` the texts used so far.
    """
    q, tried = F.col("question"), F.col("tried")
    first, second = (expand_refs(q), drop_stopwords(q)) if attempt == 0 else (drop_stopwords(q), expand_refs(q))
    boosted = F.concat(q, F.lit(" " + P.LEXICAL_BOOST))
    options = F.array(first, second, boosted)
    return F.try_element_at(F.filter(options, lambda x: ~F.array_contains(tried, x)), F.lit(1))


def merge_document_lists(primary: DataFrame, secondary: DataFrame, limit: int = 12) -> DataFrame:
    """Ordered union of two ranked lists of names, repeats (ignoring case) once."""
    both = primary.withColumn("_list", F.lit(0)).unionByName(secondary.withColumn("_list", F.lit(1)))
    folded = both.withColumn("_key", F.replace(F.lower("document"), F.lit("ß"), F.lit("ss")))
    once = Window.partitionBy(*TQ, "_key").orderBy("_list", "rank")
    order = Window.partitionBy(*TQ).orderBy("_list", "rank")
    return (
        folded.withColumn("_rn", F.row_number().over(once))
        .filter("_rn = 1")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select(*TQ, "position", "document")
    )


def query_trace(planned: DataFrame, selected: DataFrame, assessed: DataFrame) -> DataFrame:
    """One row per question: category, sources in order, verdict, hashed text."""
    ordered = F.sort_array(F.collect_list(F.struct("source_no", "chunk_id", "vector_score", "filename")))
    lists = selected.groupBy(*TQ).agg(ordered.alias("_s"))

    def joined(name: str) -> Column:
        values = F.transform("_s", lambda s: s[name].cast("string"))
        return F.coalesce(F.array_join(values, ","), F.lit(""))

    return (
        planned.join(lists, TQ, "left")
        .join(assessed.select(*TQ, "sufficient"), TQ)
        .select(
            *TQ,
            F.left(F.sha2("question", 256), F.lit(16)).alias("query_hash"),
            F.col("category").alias("query_category"),
            F.col("strategy").alias("retrieval_strategy"),
            joined("filename").alias("retrieved_documents"),
            joined("chunk_id").alias("retrieved_chunks"),
            F.when(F.col("sufficient"), "sufficient").otherwise("insufficient").alias("validation_status"),
        )
    )

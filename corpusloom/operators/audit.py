"""Answer audit: citations checked against the sources an answer was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T

KEY = ["tenant_id", "answer_id"]
LEADING = P.CITATION.replace(")", r")\A", 1)


def extract_citations(answer: Column) -> Column:
    """Cited numbers in order of appearance, each once; a dash cites both its ends only."""
    lists = F.regexp_extract_all(answer, F.lit(P.CITATION), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))))
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("decimal(38,0)")))


def context_arrays(contexts: DataFrame) -> DataFrame:
    """Sources of each answer as one ordered array: the few blocks of its prompt."""
    item = F.struct("source_no", "score", "status", "regulation_number", "article", "filename")
    return contexts.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("sources"))


def citation_validity(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds the sources and the cited numbers split into existing and invented."""
    joined = answers.join(context_arrays(contexts), KEY, "left").withColumn(
        "sources", F.coalesce("sources", F.slice(F.array(_no_source()), 1, 0))
    )
    numbered = joined.withColumn("_numbers", extract_citations(F.col("answer"))).withColumn(
        "_total", F.size("sources")
    )

    def exists(n: Column) -> Column:
        return (n >= 1) & (n <= F.col("_total"))

    return numbered.withColumns(
        {
            "cited": F.transform(F.filter("_numbers", exists), lambda n: n.cast("int")),
            "invalid": F.transform(F.filter("_numbers", lambda n: ~exists(n)), lambda n: n.cast("string")),
        }
    ).drop("_numbers", "_total")


def _no_source() -> Column:
    types = (
        ("source_no", "int"), ("score", "double"), ("status", "string"),
        ("regulation_number", "string"), ("article", "string"), ("filename", "string"),
    )
    return F.struct(*[F.lit(None).cast(t).alias(n) for n, t in types])


def cited_sources() -> Column:
    return F.transform("cited", lambda n: F.element_at("sources", n))


def citation_conflicts() -> Column:
    """One article cited from two norms."""
    named = F.filter(
        F.transform(
            cited_sources(),
            lambda s: F.struct(
                F.lower(T.strip(F.coalesce(s["article"], F.lit("")))).alias("article"),
                T.strip(F.coalesce(s["regulation_number"], F.lit(""))).alias("norm"),
            ),
        ),
        lambda s: (s["article"] != "") & (s["norm"] != ""),
    )
    return F.exists(
        named,
        lambda a: F.exists(named, lambda b: (a["article"] == b["article"]) & (a["norm"] != b["norm"])),
    )


def unverified_citations() -> Column:
    return F.exists(
        cited_sources(), lambda s: F.coalesce(s["status"], F.lit("")) != P.STATUS_IN_FORCE
    )


def unsupported_assertions(answer: Column) -> Column:
    """Sentences that oblige or hedge without a citation.

    A citation that opens a sentence belongs to the one before it.
    """
    parts = F.filter(F.transform(F.split(answer, P.ANSWER_SENTENCE, -1), T.strip), lambda s: s != "")
    opened = F.transform(
        parts,
        lambda s, i: F.struct(
            F.when((i > 0) & s.rlike(LEADING), T.strip(F.regexp_replace(s, LEADING, "")))
            .otherwise(s)
            .alias("text"),
            ((i > 0) & s.rlike(LEADING)).alias("leads"),
        ),
    )
    flagged = F.transform(
        opened,
        lambda s, i: (s["text"] != "")
        & ~s["text"].rlike(P.CITATION)
        & ~F.coalesce(F.get(opened, i + 1)["leads"], F.lit(False))
        & (s["text"].rlike(P.ASSERTION) | s["text"].rlike(P.HEDGE)),
    )
    return F.size(F.filter(flagged, lambda x: x))


def best_score() -> Column:
    scores = F.transform(cited_sources(), lambda s: F.coalesce(s["score"], F.lit(0.0)))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def borderline_score(options: Options = DEFAULTS) -> Column:
    return best_score() < options.min_relevance + options.borderline_margin


def audit_answers(answers: DataFrame, contexts: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Grounding, the need for review, and the reasons in their order."""
    checked = citation_validity(answers, contexts)
    staged = checked.withColumns(
        {
            "grounded": F.size("cited") > 0,
            "conflict": citation_conflicts(),
            "unverified": unverified_citations(),
            "unsupported": unsupported_assertions(F.col("answer")),
            "borderline": borderline_score(options),
        }
    )
    grounded = F.col("grounded")
    bad = F.size("invalid") > 0
    reasons = F.array_compact(
        F.array(
            F.when(bad, F.concat(F.lit(P.REASON_INVALID), F.array_join("invalid", ", "))),
            F.when(~grounded, P.REASON_NONE_VALID),
            F.when(grounded & F.col("conflict"), P.REASON_CONFLICT),
            F.when(grounded & F.col("unverified"), P.REASON_UNVERIFIED),
            F.when(
                grounded & (F.col("unsupported") > 0),
                F.concat(F.col("unsupported").cast("string"), F.lit(P.REASON_UNSUPPORTED)),
            ),
            F.when(grounded & F.col("borderline"), P.REASON_BORDERLINE),
        )
    )
    return staged.withColumn("reasons", reasons).withColumn("requires_review", F.size("reasons") > 0)


def generation_flags(audited: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Signs that a token limit touched the answer.

    Expects ``done_reason`` and ``prompt_eval_count``; adds ``flags`` and extends
    the reasons and the need for review.
    """
    used, window = F.coalesce("prompt_eval_count", F.lit(0)), options.context_tokens
    cut = F.coalesce(F.col("done_reason") == "length", F.lit(False))
    known = (used > 0) & F.lit(window > 0)
    full = known & (used >= int(window * 0.98))
    tight = known & ~full & (used + options.answer_tokens > window)
    return audited.withColumns(
        {
            "flags": F.array_compact(
                F.array(
                    F.when(cut, "truncated_output"),
                    F.when(full, "context_full"),
                    F.when(tight, "context_tight"),
                )
            ),
            "reasons": F.concat(
                "reasons",
                F.array_compact(F.array(F.when(cut, P.REASON_CUT), F.when(full, P.REASON_FULL))),
            ),
            "requires_review": F.col("requires_review") | cut | full,
        }
    )


def final_answers(audited: DataFrame) -> DataFrame:
    """The text shown: an ungrounded one gives way to the refusal; only cited sources stay."""
    return audited.withColumn(
        "final_answer", F.when(F.col("grounded"), F.col("answer")).otherwise(P.NO_EVIDENCE_ANSWER)
    ).withColumn("cited_sources", F.transform(cited_sources(), lambda s: s["filename"]))


def answer_outcome(audited: DataFrame) -> DataFrame:
    """``no_context``, ``grounded`` or ``needs_review``."""
    return audited.withColumn(
        "outcome",
        F.when(F.size("sources") == 0, "no_context")
        .when(F.col("grounded") & ~F.col("requires_review"), "grounded")
        .otherwise("needs_review"),
    )

"""Registered queries: answer audit, audit log, telemetry, answer quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import audit, evaluate, telemetry
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w
from corpusloom.plans.registry import query

KEY = ["tenant_id", "answer_id"]


def _checked(spark, d):
    chunks = r.cited_chunks(spark, d)
    return audit.citation_validity(w.answers(spark, d), w.answer_contexts(spark, d, chunks))


def _audited(spark, d):
    chunks = r.cited_chunks(spark, d)
    return audit.audit_answers(w.answers(spark, d), w.answer_contexts(spark, d, chunks))


@query
def extract_citations(spark, d):
    numbers = audit.extract_citations(F.col("answer"))
    return w.answers(spark, d).select(
        *KEY, F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("cited")
    )


@query
def citation_validity(spark, d):
    return _checked(spark, d).select(
        *KEY,
        F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("valid"),
        F.array_join("invalid", ",").alias("invalid"),
    )


@query
def citation_conflicts(spark, d):
    return _checked(spark, d).select(*KEY, audit.citation_conflicts().alias("conflict"))


@query
def unverified_citations(spark, d):
    return _checked(spark, d).select(*KEY, audit.unverified_citations().alias("unverified"))


@query
def unsupported_assertions(spark, d):
    return w.answers(spark, d).select(*KEY, audit.unsupported_assertions(F.col("answer")).alias("unsupported"))


@query
def borderline_score(spark, d):
    return _checked(spark, d).select(
        *KEY, F.round(audit.best_score(), 6).alias("best_score"), audit.borderline_score().alias("borderline")
    )


@query
def audit_answers(spark, d):
    return _audited(spark, d).select(
        *KEY, "grounded", "requires_review", F.array_join("reasons", " | ").alias("reasons")
    )


@query
def final_answers(spark, d):
    return audit.final_answers(_audited(spark, d)).select(
        *KEY, "final_answer", F.array_join("cited_sources", ",").alias("cited_sources")
    )


@query
def generation_flags(spark, d):
    return audit.generation_flags(_audited(spark, d)).select(
        *KEY, F.array_join("flags", ",").alias("flags"), "requires_review",
        F.array_join("reasons", " | ").alias("reasons"),
    )


@query
def answer_outcome(spark, d):
    return audit.answer_outcome(audit.generation_flags(_audited(spark, d))).select(*KEY, "outcome")


@query
def detect_abstention(spark, d):
    final = audit.final_answers(_audited(spark, d))
    return final.select(*KEY, evaluate.detect_abstention(F.col("final_answer")).alias("abstained"))


@query
def keyword_coverage(spark, d):
    """Expected words: the first ones of the conversation's first user turn."""
    turns = w.table(spark, d, "conversations")
    words = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_t"))
    asked = w.answers(spark, d).join(words, "conv_id", "left").withColumn(
        "keywords", F.coalesce(F.slice(F.split("_t", " "), 1, 5), F.array().cast("array<string>"))
    )
    return evaluate.keyword_coverage(asked).select(*KEY, "keyword_coverage")


@query
def generation_summary(spark, d):
    e = w.timed(w.table(spark, d, "events"))
    i = F.col("event_id")
    results = e.select(
        F.col("event_type").alias("group"),
        (i % 4 != 0).alias("should_answer"),
        F.when(i % 10 == 0, 503).otherwise(200).alias("http_status"),
        (i % 3 != 0).alias("grounded"),
        (i % 6 == 0).alias("abstained"),
        (i % 5).alias("cited_sources"),
        F.when(i % 7 != 0, F.col("value") > 20).alias("document_hit_at_5"),
        F.when(i % 2 == 0, F.round(F.col("user_id") / 150.0, 3)).alias("keyword_coverage"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        (i % 9).alias("embed_ms"),
        (i % 11).alias("load_duration_ms"),
        F.floor("value").cast("long").alias("chat_ms"),
        F.col("value").alias("tokens_per_second"),
    )
    return evaluate.generation_summary(results, "group")


# ------------------------------------------------------------------ telemetry


def _audit(spark, d):
    return w.audit_events(w.timed(w.table(spark, d, "events")))


@query
def pseudonymize_queries(spark, d):
    return telemetry.pseudonymize_queries(_audit(spark, d)).select("event_id", "query_text")


@query
def prune_expired(spark, d):
    return telemetry.prune_expired(_audit(spark, d), "2024-01-16 00:00:00").select("event_id", "tenant_id")


@query
def recent_audit(spark, d):
    return telemetry.recent_audit(_audit(spark, d), 100).select("tenant_id", "position", "event_id", "action")


@query
def stage_histogram(spark, d):
    return telemetry.stage_histogram(w.stages(w.timed(w.table(spark, d, "events"))))


@query
def outcome_counts(spark, d):
    out = audit.answer_outcome(audit.generation_flags(_audited(spark, d)))
    return telemetry.outcome_counts(out.withColumn("trimmed", F.col("conv_id") % 3 == 0))


def _calls(spark, d):
    return w.timed(w.table(spark, d, "events")).select(
        "event_id",
        (F.col("value") * 1_000_000_000).cast("long").alias("total_duration"),
        F.when(F.col("event_id") % 3 > 0, (F.col("value") * 1_000_000).cast("long")).alias("load_duration"),
        (F.col("event_id") % 5 * 400_000).alias("eval_duration"),
        F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("eval_count"),
    )


@query
def model_throughput(spark, d):
    return telemetry.model_throughput(_calls(spark, d)).select(
        "event_id", "total_duration_ms", "load_duration_ms", "eval_duration_ms", "tokens_per_second"
    )


@query
def generation_histograms(spark, d):
    return telemetry.generation_histograms(telemetry.model_throughput(_calls(spark, d)))


@query
def feedback_join(spark, d):
    events = w.timed(w.table(spark, d, "events")).select(
        F.lit("base").alias("tenant_id"), F.col("event_id").cast("string").alias("request_id"),
        F.col("event_type").alias("stage"),
    )
    feedback = w.table(spark, d, "labels").select(
        F.lit("base").alias("tenant_id"), F.col("doc_id").cast("string").alias("request_id"),
        (F.col("quality") == 1).alias("useful"),
    )
    return telemetry.feedback_join(events, feedback, "stage")


@query
def request_pairs(spark, d):
    return telemetry.request_pairs(_audit(spark, d)).select("event_id", "request_id", "action")


@query
def parse_json_logs(spark, d):
    """Log lines written from the event log, read back as typed columns."""
    from corpusloom.sources.files import parse_json_logs as parse

    lines = _audit(spark, d).select(
        F.to_json(
            F.struct(
                F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
                F.lit("INFO").alias("level"),
                F.lit("audit").alias("logger"),
                F.col("action").alias("msg"),
                "request_id",
                "tenant_id",
                F.floor("duration_ms").alias("duration_ms"),
            )
        ).alias("value")
    )
    return parse(lines).select("ts", "level", "msg", "request_id", "tenant_id", "duration_ms")


@query
def parse_log_variants(spark, d):
    """Log lines with a field that no column names, read by path from the line's VARIANT."""
    from corpusloom.sources.files import parse_log_variants as parse

    extra = F.struct(F.array(F.lit("a"), F.col("event_id").cast("string")).alias("path"))
    line = F.struct(F.col("action").alias("msg"), "tenant_id", F.floor("duration_ms").alias("duration_ms"), extra.alias("extra"))
    out = parse(_audit(spark, d).select(F.to_json(line).alias("value")))
    return out.select("msg", "tenant_id", "duration_ms", F.variant_get("fields", "$.extra.path[1]", "string").alias("event"))

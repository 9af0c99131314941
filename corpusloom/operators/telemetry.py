"""Audit log, stage timings, model speed, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P


def pseudonym(c: Column) -> Column:
    """Digest and length in place of a question's text."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256), F.lit(":len="), F.length(c).cast("string"))


def pseudonymize_queries(events: DataFrame, column: str = "query_text", keep_text: bool = False) -> DataFrame:
    return events if keep_text else events.withColumn(column, pseudonym(F.col(column)))


def prune_expired(events: DataFrame, cutoff: str | None) -> DataFrame:
    """Drop events before the cutoff; None keeps everything."""
    if cutoff is None:
        return events
    return events.filter(F.col("created_at") >= F.lit(cutoff).cast("timestamp"))


def recent_audit(events: DataFrame, limit: int = 100) -> DataFrame:
    """Newest events per tenant; tasks keep only that many per tenant to shuffle."""
    n = max(1, min(int(limit), 500))
    w = Window.partitionBy("tenant_id").orderBy(F.col("created_at").desc(), F.col("event_id").desc())
    return events.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def histogram(values: DataFrame, by: list[str], value: str, buckets: tuple) -> DataFrame:
    """Cumulative counts per bucket bound, as one row per bound, in a single pass."""
    clipped = F.greatest(F.col(value), F.lit(0.0))
    counts = [F.count_if(clipped <= b).alias(f"_b{i}") for i, b in enumerate(buckets)]
    wide = values.groupBy(*by).agg(
        *counts, F.count(clipped).alias("count"), F.round(F.sum(clipped), 6).alias("sum")
    )
    bounds = F.array(
        *[
            F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_b{i}").alias("cumulative"))
            for i, b in enumerate(buckets)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")),
    )
    return wide.select(*by, F.explode(bounds).alias("b"), "count", "sum").select(*by, "b.*", "count", "sum")


def stage_histogram(stages: DataFrame) -> DataFrame:
    """Seconds per stage."""
    return histogram(stages, ["stage"], "seconds", P.STAGE_BUCKETS)


def generation_histograms(calls: DataFrame) -> DataFrame:
    """Tokens per second and tokens per answer of the calls that generated something."""
    made = calls.filter("eval_count > 0")
    speed = histogram(made.filter("tokens_per_second > 0"), [], "tokens_per_second", P.SPEED_BUCKETS)
    length = histogram(made, [], "eval_count", P.LENGTH_BUCKETS)
    return speed.select(F.lit("tokens_per_second").alias("metric"), "*").unionByName(
        length.select(F.lit("answer_tokens").alias("metric"), "*")
    )


def outcome_counts(answers: DataFrame) -> DataFrame:
    """Answers by outcome and by flag, as (metric, label, total)."""
    labels = F.concat(
        F.array(F.struct(F.lit("outcome").alias("metric"), F.col("outcome").alias("label"))),
        F.transform("flags", lambda f: F.struct(F.lit("flag").alias("metric"), f.alias("label"))),
        F.when(
            F.col("trimmed"), F.array(F.struct(F.lit("trim").alias("metric"), F.lit("context").alias("label")))
        ).otherwise(F.slice(F.array(F.struct(F.lit("").alias("metric"), F.lit("").alias("label"))), 1, 0)),
    )
    return answers.select(F.explode(labels).alias("l")).groupBy("l.metric", "l.label").agg(F.count("*").alias("total"))


def model_throughput(calls: DataFrame) -> DataFrame:
    """Nanoseconds to whole milliseconds, tokens per second, 0 where nothing was generated."""

    def ms(name: str) -> Column:
        return F.coalesce(F.floor(F.col(name) / 1_000_000), F.lit(0)).cast("long")

    staged = calls.withColumns(
        {
            "total_duration_ms": ms("total_duration"),
            "load_duration_ms": ms("load_duration"),
            "eval_duration_ms": ms("eval_duration"),
            "eval_count": F.coalesce("eval_count", F.lit(0)).cast("long"),
        }
    )
    rate = F.col("eval_count") / (F.col("eval_duration_ms") / 1000.0)
    usable = (F.col("eval_duration_ms") > 0) & (F.col("eval_count") > 0)
    return staged.withColumn("tokens_per_second", F.when(usable, F.round(rate, 2)).otherwise(0.0))


def feedback_join(events: DataFrame, feedback: DataFrame, by: str) -> DataFrame:
    """Rated requests and the share found useful."""
    joined = events.join(feedback, ["tenant_id", "request_id"], "left")
    return joined.groupBy(by).agg(
        F.count("*").alias("requests"),
        F.count("useful").alias("rated"),
        F.round(F.avg(F.col("useful").cast("double")), 6).alias("useful_rate"),
    )


def request_pairs(events: DataFrame) -> DataFrame:
    """Requested actions without a completion in the same request."""
    asked = events.filter(F.col("action").endswith(".requested"))
    done = events.filter(F.col("action").endswith(".completed")).select(
        "request_id", F.regexp_replace("action", r"\.completed$", ".requested").alias("action")
    )
    return asked.join(done, ["request_id", "action"], "left_anti")


def sessions(events: DataFrame, gap_minutes: int = 20) -> DataFrame:
    """Activity sessions of each user: a pause as long as the idle limit starts a new one."""
    return (
        events.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("w"))
        .agg(F.count("*").alias("events"), F.max("ts").alias("last"))
        .select("user_id", F.col("w.start").alias("start"), "last", "events")
    )


def _runs(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Merge (start, last, events) rows of a key whose pauses stay under the gap."""
    order = Window.partitionBy(*keys).orderBy("start", "last")
    before = Window.partitionBy(*keys).orderBy("start", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(F.unix_micros("last")).over(before)
    fresh = reached.isNull() | (F.unix_micros("start") - reached >= gap_us)
    numbered = rows.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(upto))
    return numbered.groupBy(*keys, "_run").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.sum("events").alias("events")
    ).drop("_run")


def sessions_batch(events: DataFrame, gap_minutes: int = 20) -> DataFrame:
    """Batch twin of ``sessions`` that spreads a busy user over many tasks.

    Events first form runs inside each (user, hour); at most a few runs are left
    per hour, and only those are merged per user.
    """
    gap = gap_minutes * 60_000_000
    rows = events.select(
        "user_id",
        F.date_trunc("hour", "ts").alias("_hour"),
        F.col("ts").alias("start"),
        F.col("ts").alias("last"),
        F.lit(1).cast("long").alias("events"),
    )
    hourly = _runs(rows, ["user_id", "_hour"], gap).drop("_hour")
    return _runs(hourly, ["user_id"], gap)

"""Registered queries: streams over the given tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import telemetry
from corpusloom.plans import ingestion as ing
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w
from corpusloom.plans.registry import query
from corpusloom.session import shared_dir
from corpusloom.streaming import jobs, stateful


def _feed(spark, d, name):
    """The files of a table as they lie: one file of that name, or a folder of parts.

    A stream takes a single file only by a pattern; the braces hold the name and nothing else.
    """
    return spark.readStream.schema(w.table(spark, d, name).schema).parquet(f"{d.rstrip('/')}/{{{name}}}.parquet")


def _stream(spark, d, name):
    rows = _feed(spark, d, name)
    return w.timed(rows) if "ts" in rows.columns else rows


def _folder(spark):
    return f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _landed(spark, stream):
    folder = _folder(spark)
    jobs.to_parquet(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _closed(spark, d, shape):
    """The rows of a windowed stream over ``events``, those of the last open windows too.

    A window closes when later events move the watermark past it. A finite feed has none
    after its last rows, so a second run from the same checkpoint brings one closing event
    from far beyond; the window of that event alone stays open.
    """
    folder = _folder(spark)
    ends = f"{folder}/ends"
    raw = w.table(spark, d, "events")
    raw.limit(0).write.parquet(f"{ends}/none")
    feeds = [
        _feed(spark, d, "events"),
        spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").parquet(ends),
    ]
    stream = shape(w.timed(feeds[0].unionByName(feeds[1])))
    jobs.to_parquet(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    last = raw.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + INTERVAL 60 DAYS"))
    last.select(*(F.col(f.name).cast(f.dataType) for f in raw.schema)).write.parquet(f"{ends}/last")
    jobs.to_parquet(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _files(docs):
    return docs.select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        "text",
    )


def _index(docs):
    return T.with_tokens(ing.prepare_chunks(w.pages_of(docs), None).drop("body"), "text")


@query
def stream_ingest(spark, d):
    folder = _folder(spark)
    run = jobs.ingest_batch(folder, _index)
    jobs.per_batch(_files(_stream(spark, d, "documents")), run, f"{folder}/state").awaitTermination()
    schema = T.with_tokens(ing.indexed_chunks(spark, d).drop("body"), "text").schema
    out = jobs.current_chunks(spark, folder, schema)
    return out.select("chunk_id", "tenant_id", "document_id", "chunk", T.sha_hex(F.col("text")).alias("text_hash"))


#: Indexes that this application has built from a stream.
_REFRESHED: dict = {}


def _refreshed(spark, d):
    """The index after three micro-batches, with a compaction between: two halves, then every document again."""
    key = (spark.sparkContext.applicationId, d, r.version(spark, d))
    if key in _REFRESHED:
        return _REFRESHED[key].index()
    folder, raw = _folder(spark), w.table(spark, d, "documents")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    raw.limit(0).write.parquet(f"{folder}/in/none")
    feed = spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    run = jobs.ingest_batch(folder, _index, compact_every=2)
    for i, part in enumerate((raw.where(half == 0), raw.where((half == 1) | half.isNull()), raw)):
        part.write.parquet(f"{folder}/in/{i}")
        jobs.per_batch(_files(feed), run, f"{folder}/state").awaitTermination()
    _REFRESHED[key] = jobs.lexical_index(spark, folder)
    return _REFRESHED[key].index()


@query
def stream_index_refresh(spark, d):
    return _refreshed(spark, d).totals.withColumn("avg_len", F.round("avg_len", 6))


@query
def stream_index_frequencies(spark, d):
    return _refreshed(spark, d).frequencies.select("tenant_id", "term", "df")


@query
def stream_dedup_inflight(spark, d):
    """Uploads are events: who uploads, and what the event is about."""
    uploads = _stream(spark, d, "events").select(
        "ts", w.event_tenant().alias("tenant_id"), F.get_json_object("props", "$.k").alias("document_id")
    )
    return _landed(spark, jobs.dedup_inflight(uploads, "40 days")).select("tenant_id", "document_id")


@query
def stream_assemble_answers(spark, d):
    kinds = {"view": "token", "click": "token", "signup": "metadata", "purchase": "done", "error": "error"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])

    def shape(rows):
        events = rows.select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("request_id"),
            "ts",
            F.col("event_id").alias("seq"),
            kind[F.col("event_type")].alias("type"),
            F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("content"),
        )
        return jobs.assemble_answers(events.withWatermark("ts", "10 minutes"), "1 day")

    return _closed(spark, d, shape)


def _over_batches(spark, d, shape, parts=3):
    """A stateful stream fed with ``events`` in stretches of time, one micro-batch or more each, then one event from far beyond.

    That last event opens a story of its own and ends every other that waits for time to pass.
    """
    folder, raw = _folder(spark), w.table(spark, d, "events")
    raw.limit(0).write.parquet(f"{folder}/in/none")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = raw.agg(F.min(micros)).scalar()
    span = raw.agg(F.max(micros) - F.min(micros)).scalar()
    staged = raw.withColumn("_part", F.least(F.floor((micros - first) * parts / span), F.lit(parts - 1)))
    last = raw.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + INTERVAL 60 DAYS"))
    feeds = [staged.where(F.col("_part") == i).drop("_part") for i in range(parts)] + [last]
    stream = shape(w.timed(spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")))
    for i, rows in enumerate(feeds):
        rows.select(*(F.col(f.name).cast(f.dataType) for f in raw.schema)).write.parquet(f"{folder}/in/{i}")
        with stateful.own_state(spark):
            jobs.to_parquet(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_answers_early(spark, d):
    """Answers as soon as they end; the day of a user is a request, a purchase ends it and an error breaks it off."""
    kinds = {"view": "token", "click": "token", "signup": "metadata", "purchase": "done", "error": "error"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])

    def shape(rows):
        events = rows.select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("request_id"),
            "ts",
            F.col("event_id").alias("seq"),
            kind[F.col("event_type")].alias("type"),
            F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("content"),
        )
        return stateful.assemble_answers_early(events.withWatermark("ts", "10 minutes"), "1 day")

    return _over_batches(spark, d, shape)


@query
def stream_admitted_uploads(spark, d):
    """Uploads that found their slot free; purchases ask for one, signups give it back."""

    def shape(rows):
        uploads = rows.where("event_type IN ('purchase', 'signup')").select(
            w.event_tenant().alias("tenant_id"), F.get_json_object("props", "$.k").alias("document_id"), "ts",
            F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "completed").otherwise("requested").alias("kind"),
        )
        return stateful.admit_uploads(uploads.withWatermark("ts", "10 minutes"), "6 hours")

    return _over_batches(spark, d, shape).where(F.col("seq").isNotNull())


@query
def stream_stage_metrics(spark, d):
    out = _closed(spark, d, lambda rows: jobs.stage_metrics(w.stages(rows).withWatermark("ts", "10 minutes")))
    return out.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n",
        F.round("seconds", 6).alias("seconds"), F.round("slowest", 6).alias("slowest"),
    )


@query
def stream_stage_metrics_sliding(spark, d):
    out = _closed(
        spark, d, lambda rows: jobs.stage_metrics(w.stages(rows).withWatermark("ts", "10 minutes"), "1 hour", "30 minutes")
    )
    return out.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n",
        F.round("seconds", 6).alias("seconds"),
    )


@query
def stream_sessions(spark, d):
    out = _closed(spark, d, lambda rows: telemetry.sessions(rows.withWatermark("ts", "10 minutes")))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


@query
def sessions_batch(spark, d):
    out = telemetry.sessions_batch(w.timed(w.table(spark, d, "events")))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


@query
def stream_audit_sink(spark, d):
    events = w.audit_events(_stream(spark, d, "events"))
    return _landed(spark, jobs.audit_rows(events)).select("event_id", "tenant_id", "request_id", "action", "query_text")

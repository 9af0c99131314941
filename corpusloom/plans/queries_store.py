"""Registered queries: store maintenance, graph maintenance, files and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.operators import graph, store
from corpusloom.plans import ingestion as ing
from corpusloom.plans import retrieval as r
from corpusloom.plans import workload as w
from corpusloom.plans.registry import query
from corpusloom.session import shared_dir
from corpusloom.sources import files, sinks, stores
from corpusloom.sources.versioned import VersionedTable


def _chunks(spark, d):
    """Chunks without terms and vectors, which no store operation reads."""
    return r.store(spark, d).described


def _incoming(spark, d):
    """A new version of every low-quality document: its body shortened to the first two chunks."""
    deleted = w.deleted_documents(spark, d)
    new = _chunks(spark, d).join(deleted.select("tenant_id", "document_id"), ["tenant_id", "document_id"], "left_semi")
    return new.filter("chunk <= 2").withColumn("text", F.concat("text", F.lit("\nNova versao.")))


@query
def upsert_chunks(spark, d):
    out = store.upsert_chunks(_chunks(spark, d), _incoming(spark, d))
    return out.select("chunk_id", "tenant_id", T.sha_hex(F.col("text")).alias("text_hash"))


@query
def stale_chunks(spark, d):
    return store.stale_chunks(_chunks(spark, d), _incoming(spark, d))


@query
def delete_documents(spark, d):
    return store.delete_documents(_chunks(spark, d), w.deleted_documents(spark, d)).select("chunk_id", "tenant_id", "document_id")


@query
def fetch_chunks(spark, d):
    wanted = w.raw_documents(spark, d).select("tenant_id", F.concat_ws(":", "tenant_id", "document_id", F.lit("1")).alias("chunk_id"))
    return store.fetch_chunks(_chunks(spark, d), wanted).select("chunk_id", "tenant_id", "filename")


def _updates(spark, d):
    docs = w.unique_documents(spark, d)
    return docs.filter("doc_id % 4 < 3").select(
        "tenant_id",
        "document_id",
        F.when(F.col("doc_id") % 4 == 0, P.STATUS_IN_FORCE)
        .when(F.col("doc_id") % 4 == 1, P.STATUS_REVOKED)
        .otherwise(P.STATUS_UNVERIFIED)
        .alias("status"),
        F.lit("revisor").alias("validated_by"),
        F.lit("2024-01-16T00:00:00Z").alias("validated_at"),
    )


@query
def apply_status_updates(spark, d):
    out = store.apply_status_updates(_chunks(spark, d), _updates(spark, d))
    return out.select(
        "chunk_id", "status", "validated_by", "validated_at", "validation_method",
        T.sha_hex(F.col("text")).alias("text_hash"),
    )


@query
def list_documents(spark, d):
    return store.list_documents(_chunks(spark, d)).orderBy("tenant_id", F.lower("filename"))


@query
def knowledge_base_status(spark, d):
    out = store.knowledge_base_status(_chunks(spark, d))
    return out.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("*")))


@query
def tenant_ids(spark, d):
    return store.tenant_ids(_chunks(spark, d))


@query
def tenant_quota(spark, d):
    return store.tenant_quota(_chunks(spark, d))


@query
def upload_admission(spark, d):
    """Every file weighed against a small quota."""
    from dataclasses import replace

    from corpusloom.config import DEFAULTS

    out = store.tenant_quota(_chunks(spark, d), w.raw_documents(spark, d), replace(DEFAULTS, quota_bytes=400_000))
    return out.select("tenant_id", "filename", "size_bytes", "stored_bytes", "admitted")


# ------------------------------------------------------------------ stores in versions


def _stored(spark, rows):
    """A versioned table that holds ``rows``."""
    table = VersionedTable(spark, f"{shared_dir(spark).rstrip('/')}/stores/{uuid.uuid4().hex}", rows.schema)
    table.replace(rows, stores.parts_of(rows))
    return table


def _chunk_columns(spark, d):
    return _chunks(spark, d).drop("body")


@query
def vector_store_upsert(spark, d):
    kept = stores.VectorStore(_stored(spark, _chunk_columns(spark, d)))
    kept.upsert(_incoming(spark, d).drop("body"))
    return kept.table.read().select("chunk_id", "tenant_id", T.sha_hex(F.col("text")).alias("text_hash"))


@query
def vector_store_delete(spark, d):
    kept = stores.VectorStore(_stored(spark, _chunk_columns(spark, d)))
    kept.delete_documents(w.deleted_documents(spark, d))
    return kept.table.read().select("chunk_id", "tenant_id", "document_id")


@query
def vector_store_before_delete(spark, d):
    """The version before a deletion, read after it: nothing is missing."""
    kept = stores.VectorStore(_stored(spark, _chunk_columns(spark, d)))
    kept.delete_documents(w.deleted_documents(spark, d))
    return kept.table.read(version=0).select("chunk_id", "tenant_id", "document_id")


@query
def graph_store_sync(spark, d):
    again = w.deleted_documents(spark, d).select("tenant_id", "document_id")
    meta = ing.metadata(spark, d).join(again, ["tenant_id", "document_id"], "left_semi")
    fresh = graph.edge_status(graph.edge_dedup(graph.with_entities(graph.edges_from_metadata(meta))))
    kept = stores.GraphStore(_stored(spark, r.store(spark, d).edges))
    kept.sync_documents(fresh, again)
    return kept.table.read().select("edge_id", "tenant_id", "document_id", "relation", "source_span")


# ------------------------------------------------------------------ graph maintenance


@query
def graph_sync(spark, d):
    """Re-sync the low-quality documents with the edges of their own fields only."""
    st = r.store(spark, d)
    again = w.deleted_documents(spark, d).select("tenant_id", "document_id")
    meta = ing.metadata(spark, d).join(again, ["tenant_id", "document_id"], "left_semi")
    fresh = graph.edge_status(graph.edge_dedup(graph.with_entities(graph.edges_from_metadata(meta))))
    return graph.graph_sync(st.edges, fresh, again).select("edge_id", "tenant_id", "document_id", "relation", "source_span")


@query
def forget_document_edges(spark, d):
    out = graph.forget_document_edges(r.store(spark, d).edges, w.deleted_documents(spark, d))
    return out.select("edge_id", "tenant_id", "document_id", "relation")


@query
def orphan_entities(spark, d):
    st = r.store(spark, d)
    left = graph.forget_document_edges(st.edges, w.deleted_documents(spark, d))
    return graph.orphan_entities(st.entities, left).select("tenant_id", "kind", "name_normalized")


def _dated(spark, d):
    """Edges stamped with a made creation time that follows their emission order."""
    edges = r.store(spark, d).edges
    return edges.withColumn("created_at", F.expr("timestamp_seconds(1704067200 + emit_order * 60)"))


@query
def list_relations(spark, d):
    st = r.store(spark, d)
    out = graph.list_relations(_dated(spark, d), st.entities, graph.PENDING, 50)
    return out.select("tenant_id", "position", "edge_id", "subject", "relation", "object")


def _decisions(spark, d):
    """Human decisions: each topic edge is confirmed, and rejected later when weak."""
    edges = r.store(spark, d).edges.filter("relation in ('regula', 'relacionado_a')")
    made = F.array(
        F.struct(F.lit(1).alias("decision_id"), F.lit("validada").alias("status"), F.lit("ana").alias("validated_by"), F.lit("2024-01-10").alias("decided_at")),
        F.struct(F.lit(2).alias("decision_id"), F.when(F.col("confidence") < 1, "rejeitada").alias("status"), F.lit("rui").alias("validated_by"), F.lit("2024-01-12").alias("decided_at")),
    )
    return edges.select("tenant_id", "edge_id", F.explode(made).alias("d")).select("tenant_id", "edge_id", "d.*").filter("status IS NOT NULL")


@query
def validate_relations(spark, d):
    out = graph.validate_relations(r.store(spark, d).edges, _decisions(spark, d))
    return out.select("edge_id", "validation_status", "validated_by", "validated_at")


@query
def relation_prompt_lines(spark, d):
    return graph.relation_prompt_lines(r.store(spark, d).edges).select("edge_id", "line")


@query
def ingest_model_relations(spark, d):
    """Raw model output for every document: valid, unknown, broken and surplus objects."""
    i = F.col("doc_id")
    raw = F.concat(
        F.lit('Relações:\n{"relation": "regula", "target": "'), F.col("filename"),
        F.lit('", "target_kind": "tema", "confidence": '), F.round((i % 20) / 10.0 - 0.3, 2).cast("string"),
        F.lit('}\n{"relation": "inventa", "target": "x"}\n{"relation": "revoga", "object": "RDC '), (i % 400 + 1).cast("string"),
        F.lit('", "object_kind": "lei", "subject": "'), F.col("tenant_id"),
        F.lit('", "source_kind": "norma"}\n{"relation": "altera", quebrado}\n{"relation": "altera", "target": " "}\n'),
        F.lit('{"relation": "trata_de", "target": "a", "target_kind": "conceito", "confidence": "alta"}\n{"relation": "emitida_por", "target": "b", "target_kind": "fonte"}'),
    )
    outputs = w.raw_documents(spark, d).select("tenant_id", "doc_id", F.lit("Art. 1").alias("source_span"), raw.alias("raw"))
    return graph.ingest_model_relations(outputs)


# ------------------------------------------------------------------ files and sinks


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


@query
def scan_text_files(spark, d):
    """Every document written out as a file of its own, in a folder of its name, and scanned."""
    folder = _folder(spark, "texts")
    w.raw_documents(spark, d).select("filename", "text").repartition("filename").write.partitionBy("filename").text(folder)
    out = files.scan_text_files(spark, folder)
    return out.select(
        F.regexp_extract("path", "/filename=([^/]+)/", 1).alias("document"), "ext",
        F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"),
    )


@query
def reject_bad_content(spark, d):
    """Documents as raw bytes; some carry a NUL, some claim to be PDF."""
    i = F.col("doc_id")
    text = F.when(i % 9 == 0, F.concat(F.lit("a\x00"), "text")).when(i % 9 == 1, F.concat(F.lit(" %PDF-1.7\n"), "text")).otherwise(F.col("text"))
    raw = w.raw_documents(spark, d).select(
        "doc_id", "filename",
        F.when(i % 3 == 1, "pdf").when(i % 3 == 0, "md").otherwise("exe").alias("ext"),
        F.encode(text, "UTF-8").alias("content"),
    )
    return files.reject_bad_content(raw).select("doc_id", "ext", "accepted")


@query
def scan_sidecars(spark, d):
    """Sidecars written one to a file, over many lines, some of them broken, and scanned."""
    folder = _folder(spark, "sidecars")
    pretty = F.to_json(F.struct("status", "document_version"), {"pretty": "true"})
    raw = w.sidecars(spark, d).select(
        F.concat("filename", F.lit(".meta.json")).alias("name"),
        F.when(F.substring("filename", 4, 1) == "3", "{quebrado\n").otherwise(pretty).alias("value"),
    )
    raw.repartition("name").write.partitionBy("name").text(folder)
    return files.scan_sidecars(spark, folder).select("filename", "status", "document_version")


#: Cases of one evaluation file.
FILE_CASES = 50


@query
def scan_eval_json(spark, d):
    """Cases written as files of many lines, fifty cases each, and scanned."""
    from corpusloom.plans import evaluation as ev

    folder = _folder(spark, "cases")
    cases = ev.cases(spark, d)
    place = F.expr(f"cast(regexp_extract(id, '[0-9]+$', 0) as long) div {FILE_CASES}")
    body = cases.groupBy(place.alias("g")).agg(F.collect_list(F.struct(*cases.columns)).alias("cases"))
    body.select(F.to_json(F.struct("cases"), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return files.scan_eval_json(spark, folder)


@query
def scan_eval_jsonl(spark, d):
    from corpusloom.plans import evaluation as ev

    folder = _folder(spark, "lines")
    cases = ev.cases(spark, d)
    lines = cases.select(F.explode(F.array(F.lit("# caso"), F.lit("  "), F.to_json(F.struct(*cases.columns)))).alias("value"))
    lines.write.text(folder)
    return files.scan_eval_jsonl(spark, folder)


@query
def write_chunk_snapshot(spark, d):
    """Snapshot written, one tenant's rows replaced by their first chunks, read back."""
    folder = _folder(spark, "snapshot")
    chunks = _chunks(spark, d).select("chunk_id", "tenant_id", "document_id", "chunk", "text")
    sinks.write_chunk_snapshot(chunks, folder)
    sinks.write_chunk_snapshot(chunks.filter("tenant_id = 'src3' and chunk = 1"), folder)
    return spark.read.schema(chunks.schema).parquet(folder).select("chunk_id", "tenant_id", "document_id", "chunk")


@query
def write_report(spark, d):
    folder = _folder(spark, "report")
    sinks.write_report(store.knowledge_base_status(_chunks(spark, d)), folder)
    return spark.read.schema("harness_mode string, measured boolean, tenant_id string, documents long, chunks long").json(folder)


@query
def write_ndjson_events(spark, d):
    folder = _folder(spark, "events")
    events = w.audit_events(w.timed(w.table(spark, d, "events"))).select("event_id", "request_id", "action")
    sinks.write_ndjson_events(events, folder)
    return spark.read.schema(events.schema).json(folder)


@query
def append_audit(spark, d):
    folder = _folder(spark, "audit")
    events = w.audit_events(w.timed(w.table(spark, d, "events")))
    sinks.append_audit(events.filter("action like 'chat%'"), folder)
    sinks.append_audit(events.filter("action not like 'chat%'"), folder)
    return spark.read.schema(events.schema).parquet(folder).select("event_id", "tenant_id", "request_id", "action")

"""Store maintenance as set operations between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T

ID = ["tenant_id", "chunk_id"]
DOC = ["tenant_id", "document_id"]


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace stored ones of the same id; a row whose id names another
    tenant, or whose vector is of another model than the tenant's stored ones, fails the job.

    Of rows that repeat an id within a delivery one is kept, the same in every run.
    """
    one = Window.partitionBy(*ID).orderBy(F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(incoming.columns))))
    incoming = incoming.withColumn("_one", F.row_number().over(one)).where("_one = 1").drop("_one")
    own = F.col("chunk_id").startswith(F.concat("tenant_id", F.lit(":")))
    checked = incoming.withColumn(
        "tenant_id",
        F.when(own, F.col("tenant_id")).otherwise(
            F.raise_error(F.lit("tenant_id missing or different from the chunk's"))
        ),
    )
    if "embedding_model" in stored.columns and "embedding_model" in incoming.columns:
        models = stored.groupBy("tenant_id").agg(F.min("embedding_model").alias("_model"))
        mixed = F.raise_error(F.concat(F.lit("the collection holds vectors of "), "_model", F.lit(", not of "), "embedding_model"))
        checked = (
            checked.join(models, "tenant_id", "left")
            .withColumn("embedding_model", F.when(F.col("embedding_model") != F.col("_model"), mixed).otherwise(F.col("embedding_model")))
            .drop("_model")
        )
    return stored.join(incoming.select(*ID), ID, "left_anti").unionByName(checked)


def stale_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored ids of re-ingested documents that the new version no longer has."""
    touched = incoming.select(*DOC).distinct()
    return (
        stored.join(touched, DOC, "left_semi").join(incoming.select(*ID), ID, "left_anti").select(*ID, "document_id")
    )


def delete_documents(stored: DataFrame, deleted: DataFrame) -> DataFrame:
    return stored.join(deleted.select(*DOC), DOC, "left_anti")


def fetch_chunks(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    return stored.join(wanted.select(*ID), ID, "left_semi")


def apply_status_updates(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """New validity on every chunk of a document, its header line rewritten.

    ``updates``: tenant, document, status, validated_by, validated_at. Going back
    to not verified clears the validator. Vectors stay as they are.
    """
    valid = updates.select(
        *DOC,
        F.when(F.col("status").isin(*P.STATUS_LABELS), F.col("status"))
        .otherwise(F.raise_error(F.lit("invalid status")))
        .alias("_status"),
        F.col("validated_by").alias("_by"),
        F.col("validated_at").alias("_at"),
    )
    confirmed = F.col("_status") != P.STATUS_UNVERIFIED
    changed = F.col("_status").isNotNull()

    def decided(name: str, new: Column) -> Column:
        """A document without a new decision keeps its earlier one."""
        before = F.col(name) if name in stored.columns else F.lit(None).cast("string")
        return F.when(changed, F.when(confirmed, new)).otherwise(before)

    line = F.concat(F.lit("Status informado: "), T.status_label(F.col("_status")))
    rewritten = F.regexp_replace(F.col("text"), F.lit(r"(?md)^Status informado:.*$"), line)
    return (
        stored.join(valid, DOC, "left")
        .withColumns(
            {
                "text": F.when(changed, rewritten).otherwise(F.col("text")),
                "validated_by": decided("validated_by", F.col("_by")),
                "validated_at": decided("validated_at", F.col("_at")),
                "validation_method": decided("validation_method", F.lit("confirmacao_manual_na_aplicacao")),
                "status": F.coalesce("_status", "status"),
            }
        )
        .drop("_status", "_by", "_at")
    )


def list_documents(stored: DataFrame) -> DataFrame:
    """Documents with their chunk count and first-seen metadata, with their position by name."""
    first = F.min_by(
        F.struct("authority", "regulation_number", "status", "publication_date"), F.col("chunk")
    )
    return (
        stored.groupBy(*DOC, "filename")
        .agg(F.count("*").alias("chunks"), first.alias("m"))
        .select(*DOC, "filename", "chunks", "m.*")
    )


def knowledge_base_status(stored: DataFrame) -> DataFrame:
    """Documents, chunks, indexed chunks and unverified documents per tenant, and in all.

    A chunk is indexed if it has terms: those in ``tokens``, or else those that its text gives.
    """
    if "tokens" in stored.columns:
        stored = stored.withColumn("_has_terms", F.size("tokens") > 0)
    else:
        stored = T.with_has_terms(stored, "text", "_has_terms")
    docs = stored.groupBy(*DOC).agg(
        F.count("*").alias("chunks"),
        F.count_if("_has_terms").alias("indexed"),
        F.min_by("status", "chunk").alias("status"),
    )
    return docs.rollup("tenant_id").agg(
        F.count("*").alias("documents"),
        F.sum("chunks").alias("chunks"),
        F.sum("indexed").alias("bm25_index_size"),
        F.count_if(F.coalesce("status", F.lit("")) != P.STATUS_IN_FORCE).alias("unverified_documents"),
        (F.count("*") > 0).alias("ready"),
    )


def tenant_ids(stored: DataFrame) -> DataFrame:
    return stored.select("tenant_id").distinct()


def tenant_quota(
    stored: DataFrame, incoming: DataFrame | None = None, options: Options = DEFAULTS
) -> DataFrame:
    """UTF-8 bytes stored per tenant; with ``incoming`` files, whether each would fit.

    Each file is weighed on its own against what is stored, as an upload is.
    """
    used = stored.groupBy("tenant_id").agg(F.sum(F.octet_length("text")).alias("stored_bytes"))
    if incoming is None:
        return used.withColumn("over_quota", F.col("stored_bytes") > options.quota_bytes)
    weighed = incoming.select("tenant_id", "filename", F.octet_length("text").alias("size_bytes"))
    return weighed.join(used, "tenant_id", "left").withColumn(
        "stored_bytes", F.coalesce("stored_bytes", F.lit(0))
    ).withColumn("admitted", F.col("stored_bytes") + F.col("size_bytes") <= options.quota_bytes)

"""Writers: chunk snapshots, reports, event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_chunk_snapshot(chunks: DataFrame, path: str) -> None:
    """Replace the stored rows of the tenants present; other tenants stay untouched.

    Rows are rebalanced by tenant: a large tenant is split over many tasks and
    small ones share a task, so files come out few and even.
    """
    (
        chunks.hint("rebalance", "tenant_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 2_000_000)
        .partitionBy("tenant_id")
        .parquet(path)
    )


def with_envelope(result: DataFrame, mode: str = "evaluation", measured: bool = True) -> DataFrame:
    return result.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
        F.lit(mode).alias("harness_mode"),
        F.lit(measured).alias("measured"),
        "*",
    )


def write_report(result: DataFrame, path: str, mode: str = "evaluation", measured: bool = True) -> None:
    with_envelope(result, mode, measured).write.mode("overwrite").json(path)


def ndjson(events: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def write_ndjson_events(events: DataFrame, path: str) -> None:
    ndjson(events).write.mode("overwrite").text(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)

"""A table in versions, whose changes rewrite the parts they touch and nothing else.

Rows lie in parts of (tenant, hash of the document). A change writes the new rows of its parts into a folder of
its own and then a manifest, which names for every part the write that holds it. A version is there once its
manifest is complete: a change that fails leaves the version before it, readers of an older version see it whole, and
parts that were not touched keep their files. Part and tenant are folders, so a tenant's rows are read alone.

One writer at a time. A part whose tenant is null or empty is refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.session import drop_tables, exists, folders

PARTS = 8
PART = ["tenant_id", "part"]
MANIFEST = "tenant_id string, part int, write string"
#: Up to so many tenants are named to the scan; more are met by a join that prunes folders as it runs.
NAMED_TENANTS = 200


def with_part(rows: DataFrame) -> DataFrame:
    """Rows with the part they lie in; needs tenant_id and document_id."""
    known = F.when(F.col("tenant_id") != "", F.col("tenant_id")).otherwise(F.raise_error(F.lit("a row without a tenant")))
    return rows.withColumns({"tenant_id": known, "part": F.pmod(F.xxhash64("tenant_id", "document_id"), F.lit(PARTS)).cast("int")})


@dataclass(frozen=True)
class VersionedTable:
    """Rows of ``schema`` (with tenant_id and document_id) under ``path``."""

    spark: SparkSession
    path: str
    schema: StructType

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        found = folders(self.spark, f"{self.path}/versions")
        done = (n for n in found if exists(self.spark, f"{self.path}/versions/{n}/_SUCCESS"))
        return sorted(int(n.split("=")[1]) for n in done)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(tenant_id, part, write) of a version, the last one by default."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        chosen = known[-1] if version is None else version
        if chosen not in known:
            raise ValueError(f"no version {chosen}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/version={chosen}")

    def read(self, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Rows of a version; with ``only`` (tenant_id, part), of these parts."""
        held = self.manifest(version)
        if only is not None:
            held = held.join(only.select(*PART).distinct(), PART, "left_semi")
        if not exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], self.schema)
        placed = StructType([f for f in self.schema if f.name != "tenant_id"])
        rows = self.spark.read.schema(placed.add("write", "string").add("tenant_id", "string").add("part", "integer")).parquet(f"{self.path}/data")
        tenants = [r[0] for r in held.select("tenant_id").distinct().limit(NAMED_TENANTS + 1).collect()]
        if len(tenants) <= NAMED_TENANTS:
            rows = rows.where(F.col("tenant_id").isin(tenants))
        return rows.join(held, ["write", *PART], "left_semi").select(*self.schema.names)

    def of_tenant(self, tenant: str, version: int | None = None) -> DataFrame:
        return self.read(version, self.manifest(version).where(F.col("tenant_id") == tenant))

    def replace(self, rows: DataFrame, touched: DataFrame) -> int:
        """Publish a version in which ``rows`` are all rows of the ``touched`` parts (tenant_id, part)."""
        write, last = uuid.uuid4().hex, self.versions()
        placed = with_part(rows.select(*self.schema.names))
        placed.repartition(*PART).write.partitionBy(*PART).parquet(f"{self.path}/data/write={write}")
        landed = self.spark.read.schema("tenant_id string, part int").parquet(f"{self.path}/data/write={write}")
        new = landed.select(*PART).distinct().withColumn("write", F.lit(write))
        kept = self.manifest().join(touched.select(*PART).distinct(), PART, "left_anti")
        version = last[-1] + 1 if last else 0
        kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all versions but the last ``keep`` and the writes that no kept version names."""
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        named = {r[0] for v in kept for r in self.manifest(v).select("write").distinct().collect()}
        gone = [f"{self.path}/versions/version={v}" for v in old]
        gone += [f"{self.path}/data/{n}" for n in folders(self.spark, f"{self.path}/data") if n.split("=")[1] not in named]
        dropped = list(gone)
        drop_tables(self.spark, gone)
        return dropped

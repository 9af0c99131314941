"""Versioned tables and the two stores over them."""

import glob
import os
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import patterns as P
from corpusloom.operators import store
from corpusloom.sources.stores import GraphStore, VectorStore, parts_of
from corpusloom.sources.versioned import VersionedTable

CHUNK = (
    "tenant_id string, document_id string, chunk_id string, chunk int, filename string, text string, status string, authority string, "
    "regulation_number string, publication_date string, validated_by string, validated_at string, validation_method string, "
    "embedding array<float>, embedding_model string"
)


def chunk(tenant, doc, n, text="Status informado: x\ncorpo", vector=(1.0, 0.0)):
    return (tenant, doc, f"{tenant}:{doc}:{n}", n, f"{doc}.md", text, P.STATUS_UNVERIFIED, None, None, None, None, None, None, list(vector), "m")


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


@pytest.fixture
def kept(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "v"), StructType.fromDDL(CHUNK))
    out = VectorStore(table)
    out.upsert(chunks(spark, *(chunk(t, f"d{i}", n) for t in ("a", "b#1", "c/x") for i in range(6) for n in (1, 2))))
    return out


def ids(df):
    return sorted(r["chunk_id"] for r in df.select("chunk_id").collect())


def files_of(kept, tenant):
    """The data files that a tenant's manifest names."""
    out = []
    for r in kept.table.manifest().where(F.col("tenant_id") == tenant).collect():
        out += glob.glob(f"{kept.table.path}/data/write={r['write']}/tenant_id=*/part={r['part']}/*.parquet")
    return sorted(f for f in out if f"tenant_id={quote(tenant, safe='')}/" in f)


def documents(spark, *pairs):
    return spark.createDataFrame(list(pairs), "tenant_id string, document_id string")


def test_a_change_rewrites_touched_parts_only(spark, kept):
    before = {t: files_of(kept, t) for t in ("a", "b#1", "c/x")}
    whole = ids(kept.table.read())
    kept.delete_documents(documents(spark, ("a", "d1")))
    after = {t: files_of(kept, t) for t in before}
    assert after["b#1"] == before["b#1"] and after["c/x"] == before["c/x"]
    assert set(after["a"]) & set(before["a"]) and set(before["a"]) - set(after["a"])
    assert ids(kept.table.read()) == [i for i in whole if not i.startswith("a:d1:")]
    # a reader of the version before sees it whole
    assert ids(kept.table.read(version=0)) == whole


def test_one_tenant_is_read_alone(spark, kept):
    plan = kept.table.of_tenant("b#1")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "tenant_id" in filters and "b#1" in filters
    assert ids(kept.table.of_tenant("b#1")) == sorted(f"b#1:d{i}:{n}" for i in range(6) for n in (1, 2))
    assert kept.count_chunks("b#1") == 12 and kept.count_chunks("nobody") == 0


def test_upsert_replaces_and_takes_a_repeated_id_once(spark, kept):
    new = chunks(spark, chunk("a", "d0", 1, "neu"), chunk("a", "d0", 1, "neu"), chunk("a", "d0", 1, "anders"), chunk("n", "d9", 1))
    kept.upsert(new)
    got = kept.table.read().where("document_id = 'd0' AND tenant_id = 'a' OR tenant_id = 'n'")
    assert ids(got) == ["a:d0:1", "a:d0:2", "n:d9:1"]
    assert got.where("chunk_id = 'a:d0:1'").first()["text"] in ("neu", "anders")
    with pytest.raises(Exception, match="tenant_id missing or different"):
        kept.upsert(chunks(spark, ("a", "d0", "b#1:d0:1", *chunk("a", "d0", 1)[3:])))


def test_a_failed_change_leaves_the_version_before(spark, kept):
    whole, versions = ids(kept.table.read()), kept.table.versions()
    bad = chunks(spark, chunk("a", "d0", 1), chunk("a", "d0", 3)).withColumn(
        "text", F.when(F.col("chunk") == 3, F.raise_error(F.lit("kaputt"))).otherwise(F.col("text"))
    )
    with pytest.raises(Exception, match="kaputt"):
        kept.table.replace(bad, parts_of(bad))
    assert kept.table.versions() == versions and ids(kept.table.read()) == whole
    # a manifest that was never finished is no version
    os.makedirs(f"{kept.table.path}/versions/version=9")
    assert kept.table.versions() == versions


def test_every_method_of_the_vector_store(spark, kept):
    assert kept.health() and not VectorStore(VersionedTable(spark, "/nowhere/at/all", StructType.fromDDL(CHUNK))).health()
    assert sorted(r[0] for r in kept.tenant_ids().collect()) == ["a", "b#1", "c/x"]
    assert ids(kept.chunk_ids_for_document("c/x", "d3")) == ["c/x:d3:1", "c/x:d3:2"]
    assert kept.all_chunks("a").count() == 12
    assert [(r["document_id"], r["chunks"]) for r in kept.list_documents("a").orderBy("document_id").collect()] == [(f"d{i}", 2) for i in range(6)]
    assert kept.tenant_text_bytes("a") == 12 * len("Status informado: x\ncorpo") and kept.tenant_text_bytes("z") == 0
    wanted = spark.createDataFrame([("a", "a:d1:1"), ("b#1", "a:d1:2")], "tenant_id string, chunk_id string")
    assert ids(kept.get_chunks(wanted)) == ["a:d1:1"]
    kept.delete_ids(spark.createDataFrame([("a", "a:d1:1"), ("a", "keine")], "tenant_id string, chunk_id string"))
    assert "a:d1:1" not in ids(kept.table.read()) and kept.count_chunks("a") == 11
    updates = spark.createDataFrame([("a", "d2", P.STATUS_IN_FORCE, "ana", "2024")], "tenant_id string, document_id string, status string, validated_by string, validated_at string")
    kept.update_status(updates)
    changed = kept.table.read().where("status <> 'x'").where(F.col("status") == P.STATUS_IN_FORCE)
    assert ids(changed) == ["a:d2:1", "a:d2:2"] and {r["validated_by"] for r in changed.collect()} == {"ana"}
    # the next decision leaves this one alone
    kept.update_status(updates.withColumn("document_id", F.lit("d3")).withColumn("validated_by", F.lit("rui")))
    by = {r["document_id"]: r["validated_by"] for r in kept.table.of_tenant("a").collect()}
    assert (by["d2"], by["d3"], by["d4"]) == ("ana", "rui", None)
    kept.upsert(chunks(spark, chunk("a", "d5", 1, vector=(0.0, 1.0))))
    asked = spark.createDataFrame([("a", 1, [0.0, 1.0])], "tenant_id string, query_id long, embedding array<float>")
    assert kept.query(asked).orderBy("vector_rank").first()["chunk_id"] == "a:d5:1"


def test_vacuum_keeps_what_the_last_versions_name(spark, kept):
    kept.delete_documents(documents(spark, ("a", "d1")))
    kept.delete_documents(documents(spark, ("a", "d2"), ("a", "d3"), ("a", "d4")))
    whole = ids(kept.table.read())
    kept.table.vacuum()
    assert kept.table.versions() == [2] and ids(kept.table.read()) == whole
    writes = {r[0] for r in kept.table.manifest().select("write").distinct().collect()}
    assert {os.path.basename(p).split("=")[1] for p in glob.glob(f"{kept.table.path}/data/write=*")} == writes


def test_rows_without_a_tenant_are_refused(spark, kept):
    for tenant in (None, ""):
        rows = chunks(spark, chunk("a", "d", 1)).withColumn("tenant_id", F.lit(tenant).cast("string"))
        with pytest.raises(Exception, match="without a tenant"):
            kept.table.replace(rows, documents(spark).withColumn("part", F.lit(0)))


def test_an_empty_store_answers(spark, tmp_path):
    empty = VectorStore(VersionedTable(spark, str(tmp_path / "none"), StructType.fromDDL(CHUNK)))
    assert empty.count_chunks("a") == 0 and empty.tenant_ids().count() == 0 and empty.table.versions() == []


EDGE = "tenant_id string, edge_id string, document_id string, relation string, validation_status string, validated_by string, validated_at string"


def test_graph_store(spark, tmp_path):
    def edges(*rows):
        return spark.createDataFrame([(t, e, d, r, "pendente", None, None) for t, e, d, r in rows], EDGE)

    kept = GraphStore(VersionedTable(spark, str(tmp_path / "g"), StructType.fromDDL(EDGE)))
    kept.sync_documents(edges(("a", "1", "d1", "regula"), ("a", "2", "d2", "regula"), ("b", "3", "d1", "regula")), documents(spark, ("a", "d1"), ("a", "d2"), ("b", "d1")))
    kept.sync_documents(edges(("a", "4", "d1", "altera")), documents(spark, ("a", "d1"), ("a", "nie")))
    assert sorted(r["edge_id"] for r in kept.table.read().collect()) == ["2", "3", "4"]
    decisions = spark.createDataFrame([("a", "2", 1, "validada", "ana", "t1"), ("a", "2", 2, "rejeitada", "rui", "t2")], "tenant_id string, edge_id string, decision_id int, status string, validated_by string, decided_at string")
    kept.set_validation_status(decisions)
    got = {r["edge_id"]: (r["validation_status"], r["validated_by"]) for r in kept.table.read().collect()}
    assert got == {"2": ("rejeitada", "rui"), "3": ("pendente", None), "4": ("pendente", None)}
    kept.forget_documents(documents(spark, ("a", "d2")))
    assert sorted(r["edge_id"] for r in kept.table.of_tenant("a").collect()) == ["4"]


def test_a_delivery_that_repeats_an_id(spark):
    stored, new = chunks(spark, chunk("a", "d0", 1)), chunks(spark, chunk("a", "d0", 2, "x"), chunk("a", "d0", 2, "y"), chunk("a", "d0", 2, "x"))
    once = [sorted(map(str, store.upsert_chunks(stored, new.repartition(n)).collect())) for n in (1, 3)]
    assert once[0] == once[1] and len(once[0]) == 2

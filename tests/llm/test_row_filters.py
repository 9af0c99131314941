"""Filters that send bitmaps to the rows: the same rows with bitmaps and with the join beyond their limit."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common


@pytest.mark.parametrize("most", [0, common.BITMAP_BYTES])
def test_only_keeps_exactly_the_rows_named(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAP_BYTES", most)
    rows = spark.range(0, 40_000, 1, 3).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("block"))
    rows = common.written(rows)
    keys = common.written(rows.where("block % 7 = 3").select("row").union(rows.where("block = 3").select("row")))
    got = [r.block for r in common.only(rows, "row", keys).orderBy("block").collect()]
    assert got == list(range(3, 40_000, 7))
    assert common.only(rows, "row", keys.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, common.BITMAP_BYTES])
def test_likely_loses_none_and_rules_out_most(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BITMAP_BYTES", most)
    rows = spark.range(0, 30_000, 1, 3).select((F.col("id") * 1_000_003 - 500_000).alias("bucket"))
    keys = common.written(rows.where("bucket % 10 = 0"))
    left = common.likely(rows, "bucket", keys)
    assert left.join(keys, "bucket", "left_semi").count() == keys.count()
    assert left.count() == 30_000 if most == 0 else left.count() < keys.count() + 30_000 // 10

"""Mix sources to target weights by subset-sum budget fitting.

Targets share the words of all documents by weight; a target stops at ``MOST`` times
its source's size and the excess is shared again by weight among the others.

A source takes each document as often as its target holds the whole source. For the
budget that remains, documents are counted by exact length. Every length first gives the
same share of its documents, rounded down, then one more from the longest lengths on while
it fits; what is left, less than a few of the longest documents, is filled exactly
(or as nearly as the lengths allow) by a bounded-knapsack dynamic programme over the
copies of each length not taken yet. The copies of a length are dealt evenly to its
documents; which of them get one more is decided by a seeded hash.

One task sees the length counts of one source, never its documents. The choice among
documents of one length and source first counts hash bins, so that a third of all rows
in one such group are neither sorted nor gathered in one place.

Edge cases: a null text has size 0; documents of size 0 are never taken. A null source is
a source, placed last. Rows with the same doc_id and text share a hash and are told apart
by a row number inside their hash bin, which is then the only order among equals.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import word_count
from corpusloom.session import written

WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
MOST = 3
SEED = 11
#: Hash bins of a (source, length) group.
BINS = 4096


def ranked(sources: DataFrame) -> DataFrame:
    """``place``: position of each source by code point, null last.

    Ranges of sources are numbered in their own tasks; only the number of rows of
    each range goes through the driver.
    """
    parts = written(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33).cast("int"))
        .withColumn("inside", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    spark = sources.sparkSession
    before, rows = 0, []
    for row in parts.groupBy("part").count().orderBy("part").collect():
        rows.append((row.part, before))
        before += row["count"]
    starts = spark.createDataFrame(rows, "part int, start long")
    return parts.join(starts, "part").select("source", "source_size", (F.col("inside") + F.col("start")).alias("place"))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target. ``sources`` has one row per source with its size."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    table = written(ranked(sources).withColumn("weight", weight.cast("double")))
    most = MOST * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share = None
    while True:
        # Sources above their stop at the current share are stopped; the others share what is left.
        stopped = F.lit(False) if share is None else (F.col("weight") * share > most)
        free = table.agg(
            F.sum(F.when(stopped, most).otherwise(0)).alias("used"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(stopped.cast("long")).alias("stopped"),
        ).first()
        if not free.weight:
            break
        now = (total - free.used) / free.weight
        if share is not None and now <= share:
            break
        share = now
    target = F.least(F.col("weight") * (share or 0.0), most.cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes nearest below or at ``budget``.

    Reachable sums are the bits of one integer; lots of 1, 2, 4, ... documents of a length are
    added one after another, and the lot that first reached a sum is kept to walk back.
    """
    take = np.zeros(len(lengths), np.int64)
    reached, lots, mask = 1, [], (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int32)
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        size, left = 1, min(count, budget // length if length else 0)
        while left > 0:
            lot = min(size, left)
            new = (reached << (lot * length)) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(lots)
                reached |= new
            lots.append((k, lot))
            left -= lot
            size *= 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at:
        k, lot = lots[first[at]]
        take[k] += lot
        at -= lot * int(lengths[k])
    return take


def fitted(lengths: np.ndarray, counts: np.ndarray, bound: np.ndarray, budget: int) -> np.ndarray:
    """Copies to take of each length, at most ``bound``, for a sum near ``budget``.

    ``counts``: documents of each length; ``budget`` is less than all of them hold.
    """
    whole = int(lengths @ counts)
    share = np.array([int(c) * budget // whole for c in counts], np.int64)
    room = np.where(lengths <= budget - int(lengths @ share), bound - share, 0)
    if int(lengths @ (share + room)) <= budget:  # only documents that are too long remain
        return share + room
    best = share
    for limit in (counts, bound):  # documents are repeated only if they cannot fit otherwise
        take = filled(lengths, share, limit, budget)
        if int(lengths @ take) > int(lengths @ best):
            best = take
        if int(lengths @ best) == budget:
            break
    return best


def filled(lengths: np.ndarray, share: np.ndarray, limit: np.ndarray, budget: int) -> np.ndarray:
    """``share`` and more copies, up to ``limit`` of each length, for a sum near ``budget``."""
    take, left = share.copy(), budget - int(lengths @ share)
    longest = np.argsort(-lengths, kind="stable")
    for k in longest:
        if lengths[k] <= left and take[k] < limit[k]:
            take[k] += 1
            left -= int(lengths[k])
    # Give back one document of the longest lengths, so that the programme has room to fit.
    for k in longest[:2]:
        if take[k]:
            take[k] -= 1
            left += int(lengths[k])
    if left > 0:
        order = longest[::-1]
        order = order[lengths[order] <= left]
        take[order] += knapsack(lengths[order], (limit - take)[order], left)
    return take


def quotas(counted: DataFrame) -> DataFrame:
    """source, size, whole (times every document is taken), extra (documents taken once more)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(MOST, int(target // total)) if total else 0
        copies = whole * counts
        if total and whole < MOST:
            copies = copies + fitted(lengths, counts, (MOST - whole) * counts, min(round(target - whole * total), total - 1))
        return pd.DataFrame({"source": group["source"], "size": lengths, "whole": copies // counts, "extra": copies % counts})

    return counted.groupBy("source").applyInPandas(run, "source string, size long, whole long, extra long")


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``: doc_id, size, source_size, target, taken, and the columns in ``keep``."""
    kept = [c for c in keep if c not in ("doc_id", "source", "text")]
    texts = ["text"] if "text" in keep else []
    drawn = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED))
    sized = written(
        docs.select("doc_id", "source", *kept, *texts, word_count(F.col("text")).alias("size"), drawn.alias("draw"))
        .withColumn("bin", F.pmod("draw", F.lit(BINS)).cast("int"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    binned = written(sized.groupBy("source", "size", "bin").agg(F.count("*").alias("n")))
    counted = binned.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = written(targets(totals))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    plan = quotas(
        counted.where("size > 0").alias("l").join(aims.alias("r"), same).select("l.source", "size", "n", "source_size", "target")
    )
    # Whole bins are taken up to the bin in which the quota ends; there the rows are numbered.
    earlier = Window.partitionBy("l.source", "l.size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        binned.where("size > 0").alias("l")
        .join(plan.alias("r"), same & (F.col("l.size") == F.col("r.size")))
        .select("l.source", "l.size", "bin", "whole", (F.col("extra") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("room"), "n")
        .select("source", "size", "bin", "whole", F.greatest(F.lit(0), F.least("room", "n")).alias("room"), "n")
    )
    cut = written(cut)
    bins = ["source", "size", "bin"]
    on = same & (F.col("l.size") == F.col("r.size")) & (F.col("l.bin") == F.col("r.bin"))
    split = cut.where("room > 0 and room < n").select(*bins)
    inside = Window.partitionBy(*bins).orderBy("draw", "doc_id", "row")
    keyed = sized.select(*bins, "draw", "doc_id", "row")
    ends = (
        keyed.alias("l").join(split.alias("r"), on, "left_semi")
        .select("row", F.row_number().over(inside).alias("number"))
    )
    once = F.coalesce(F.col("number") <= F.col("room"), F.col("room") == F.col("n"), F.lit(False)).cast("long")
    decided = (
        keyed.alias("l").join(cut.alias("r"), on).select("row", "whole", "room", "n")
        .join(ends, "row", "left").select("row", (F.col("whole") + once).alias("times"))
    )
    times = F.coalesce("times", F.lit(0))
    wanted = [F.col(f"l.{c}") for c in keep if c != "doc_id"]
    return (
        sized.join(decided, "row", "left").alias("l").join(aims.alias("r"), same)
        .select("doc_id", *wanted, "size", "source_size", "target", (times * F.col("size")).alias("taken"))
    )

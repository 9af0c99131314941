"""Near-duplicate chunks of a corpus by token overlap.

The same measure that removes repeats among one question's candidates, for all chunks of a
tenant. Chunks with equal sets of terms are one class from the start, so copies never
meet one another. Classes meet on their rarest terms only: of two sets whose overlap
is at least ``t``, the (1 - t) share of rarest terms, rounded up by one, has a term in common.
Pairs that meet are compared exactly.

Any order of terms that all sets share finds the same pairs; a good one meets few others. Terms are ordered by the
counts of the buckets that their hashes fall into, a table of fixed size that goes to all tasks, so only the hashes of
the rarest terms are ever shuffled. Each set has 256 bits, every term turning one of them over: two sets differ in at
least as many terms as bits, so pairs that differ in too many bits are dropped before their terms are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import text as T
from corpusloom.session import written


#: Buckets that terms are counted in (16 MB of counts), and parts that the counts are added up in.
BUCKETS, PARTS = 1 << 22, 64


def _key(term: Column) -> Column:
    return F.xxhash64("tenant_id", term)


def bucket_counts(classes: DataFrame) -> np.ndarray:
    """In how many sets the terms of each bucket lie; ``BUCKETS`` numbers, whatever the number of sets."""
    keys = classes.select(F.explode(F.transform("terms", _key)).alias("key"))
    counts = keys.groupBy(F.pmod("key", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    width = BUCKETS // PARTS

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bucket, n = (batch.column(i).to_numpy() for i in (0, 1))
            for part in np.unique(bucket // width):
                here = bucket // width == part
                parts.setdefault(int(part), np.zeros(width, "<i4"))[bucket[here] % width] = np.minimum(n[here], 2**31 - 1)
        for part, held in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["part", "held"])

    placed = counts.repartition(PARTS, F.floor(F.col("bucket") / width))
    out = np.zeros(BUCKETS, "<i4")
    for part, held in placed.mapInArrow(added, "part int, held binary").collect():
        out[part * width : (part + 1) * width] = np.frombuffer(held, "<i4")
    return out


#: Words of a set's bits.
BITS = ("w0", "w1", "w2", "w3")


def rarest_keys(classes: DataFrame, share: float) -> DataFrame:
    """no, n, w0 to w3, keys: of each set its bits and the hashes of its rarest terms, as many as a similar set cannot miss altogether."""
    counts = classes.sparkSession.sparkContext.broadcast(bucket_counts(classes))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(1)
            sizes = keys.value_lengths().to_numpy()
            flat = keys.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.cumsum(sizes) - sizes
            turned = np.left_shift(np.uint64(1), (flat & 63).astype(np.uint64))
            words = [np.bitwise_xor.reduceat(np.where((flat >> 6) & 3 == i, turned, np.uint64(0)), starts) for i in range(len(BITS))]
            flat = flat[np.lexsort((flat, counts.value[flat % BUCKETS], row))]
            kept = (sizes - np.ceil(sizes * share - 1e-9) + 1).astype(np.int64)
            flat = flat[np.arange(len(row)) - starts[row] < kept[row]]
            offsets = pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat))
            columns = [batch.column(0), pa.array(sizes.astype(np.int32)), *(pa.array(w.view(np.int64)) for w in words), lists]
            yield pa.RecordBatch.from_arrays(columns, ["no", "n", *BITS, "keys"])

    hashed = classes.select("no", F.transform("terms", _key).alias("keys"))
    return hashed.mapInArrow(picked, f"no long, n int, {', '.join(f'{w} long' for w in BITS)}, keys array<long>")


def term_classes(chunks: DataFrame) -> DataFrame:
    """tenant_id, representative (smallest chunk id), members, terms: one row per different set of terms.

    ``chunks``: tenant_id, chunk_id, tokens. Chunks without terms are left out.
    """
    sets = chunks.select("tenant_id", "chunk_id", F.array_sort(F.array_distinct("tokens")).alias("terms")).filter("size(terms) > 0")
    key = F.sha2(F.array_join("terms", "\n"), 256)
    return sets.groupBy("tenant_id", key.alias("set_key")).agg(
        F.min("chunk_id").alias("representative"), F.count("*").alias("members"), F.first("terms").alias("terms")
    )


def near_duplicate_chunks(chunks: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Pairs of class representatives whose terms overlap enough: tenant_id, left_id, right_id, similarity."""
    t = options.dedup_similarity
    named = term_classes(chunks).select("tenant_id", F.col("representative").alias("id"), "terms")
    classes = written(named.withColumn("no", F.monotonically_increasing_id()))
    ends = rarest_keys(classes, t).select("no", "n", *BITS, F.explode("keys").alias("key"))
    a, b = ends.alias("a"), ends.alias("b")
    like = F.least("a.n", "b.n") >= t * F.greatest("a.n", "b.n") - 1e-9
    bits = reduce(add, [F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in BITS])
    close = bits <= (F.col("a.n") + F.col("b.n")) * ((1 - t) / (1 + t)) + 1e-6
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.no") < F.col("b.no")) & like & close
    # Stored, so the planner knows how many pairs ask for their terms.
    met = written(a.join(b, on).select(F.col("a.no").alias("a"), F.col("b.no").alias("b")).distinct())

    def side(name: str) -> DataFrame:
        return classes.select(F.col("no").alias(name), F.struct("id", "tenant_id", "terms").alias(f"_{name}"))

    left, right = F.least("_a", "_b"), F.greatest("_a", "_b")
    pairs = met.join(side("a"), "a").join(side("b"), "b").where("_a.tenant_id = _b.tenant_id").select(left.alias("l"), right.alias("r"))
    scored = pairs.select(
        "l.tenant_id", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), T.jaccard(F.col("l.terms"), F.col("r.terms")).alias("similarity")
    )
    return scored.filter(F.col("similarity") >= t).withColumn("similarity", F.round("similarity", 6))


def class_members(chunks: DataFrame) -> DataFrame:
    """tenant_id, chunk_id, representative, members: which class each chunk belongs to, and its size.

    With the pairs of ``near_duplicate_chunks`` this gives every pair of chunks, exact copies included.
    """
    key = F.sha2(F.array_join(F.array_sort(F.array_distinct("tokens")), "\n"), 256)
    keyed = chunks.filter("size(tokens) > 0").select("tenant_id", "chunk_id", key.alias("set_key"))
    return keyed.join(term_classes(chunks).select("tenant_id", "set_key", "representative", "members"), ["tenant_id", "set_key"]).drop("set_key")

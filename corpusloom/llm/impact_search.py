"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt by hash into blocks of a bounded size. A block's index holds, for every
dimension, the vectors in order of that component, cut into segments of a quantised
value: from one end they are postings of descending impact for positive query weights, from
the other end for negative ones. A query takes a block's segments in descending order of impact
and adds the least that a segment can give to its vectors. What segments not taken can
still add, and what quantisation may hide, bound every score from above. The query stops
only when this proves that few vectors can be among its best k (or all segments are
taken); these possible members are scored exactly. The k best of each block meet in a
second step.

Queries are packed into chunks of a bounded size, and every chunk meets every block: a task
holds one block and one chunk. This is the stated query set against all rows, in blocks.

Edge cases: vectors that are null, or hold null or non-finite components, and rows without
an id take no part. Rows that repeat an id are candidates of their own, for queries with other ids;
queries that repeat an id share one list of k rows. Shorter vectors are filled with zeros. A query
never finds its own id. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import written

SCALE = 1024
#: Vectors of a block and queries of a chunk, about.
BLOCK, CHUNK = 8192, 2048
LEVELS = 16
#: Times at which a query asks whether it may stop.
STOPS = 12


def components(vector: Column) -> Column:
    """Components as floor(SCALE * x) of those vectors that take part, else null."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * SCALE)))


def sound_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v of the rows that take part."""
    return rows.select(F.col(vec_id).alias("vec_id"), components(F.col(vector)).alias("v")).where("vec_id is not null and v is not null")


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def packed(rows: DataFrame, most: int, key: str) -> tuple[DataFrame, int]:
    """Rows dealt into packs of about ``most``: key, ids, width, data. Also the number of packs."""
    packs = max(1, -(-rows.count() // most))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        width = max(map(len, group["v"]))
        data = matrix(group["v"].tolist(), width)
        return pd.DataFrame({key: [group[key].iloc[0]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "width": [width], "data": [data.tobytes()]})

    # Dealt by row, so that rows with one id do not meet in one pack.
    dealt = rows.withColumn(key, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(packs)).cast("int"))
    return dealt.groupBy(key).applyInPandas(run, f"{key} int, ids binary, width int, data binary"), packs


class Index:
    """Impact-ordered postings of a block."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        n, width = data.shape
        self.low, self.high = data.min(0), data.max(0)
        self.step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        self.order = np.argsort(data, axis=0, kind="stable").astype(np.int32)
        level = (data - self.low) // self.step
        # Where each level of each dimension begins in the dimension's order.
        self.starts = np.stack([np.searchsorted(level[self.order[:, d], d], np.arange(LEVELS + 1)) for d in range(width)]) if width else np.zeros((0, LEVELS + 1), int)

    def segments(self, q: np.ndarray):
        """Dimension, level, least and most excess of the segments that can add something, impact descending."""
        d, level = (x.ravel() for x in np.meshgrid(np.arange(len(q)), np.arange(LEVELS), indexing="ij"))
        bottom = level * self.step[d]
        top = np.minimum(bottom + self.step[d] - 1, (self.high - self.low)[d])
        span = (self.high - self.low)[d]
        up = q[d] > 0
        least = np.abs(q[d]) * np.where(up, bottom, span - top)
        most = np.abs(q[d]) * np.where(up, top, span - bottom)
        some = (self.starts[d, level + 1] > self.starts[d, level]) & (most > 0)
        d, level, least, most = d[some], level[some], least[some], most[some]
        order = np.argsort(-most, kind="stable")
        return d[order], level[order], least[order], most[order]

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids."""
        n = len(self.ids)
        d, level, least, most = self.segments(q)
        sums = np.zeros(n)
        hidden = float(np.abs(q) @ (self.step - 1))
        self_at = self.ids == own
        cuts = np.unique(np.linspace(0, len(d), STOPS + 1).astype(int))
        possible = np.arange(n)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            parts = [self.order[self.starts[x, y] : self.starts[x, y + 1], x] for x, y in zip(d[a:b], level[a:b], strict=True)]
            sums += np.bincount(np.concatenate(parts), np.repeat(least[a:b].astype(float), [len(p) for p in parts]), n)
            left = np.zeros(len(q))
            np.maximum.at(left, d[b:], most[b:].astype(float))
            known = np.where(self_at, -np.inf, sums)
            if n > k:
                floor = np.partition(known, n - k)[n - k]
                possible = np.flatnonzero(known + left.sum() + hidden >= floor)
            if len(possible) <= max(4 * k, n // 64):
                break
        possible = possible[~self_at[possible]]
        scores = self.data[possible] @ q
        ids = self.ids[possible]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and v (``sound_vectors``)."""
    index, blocks = packed(vectors, BLOCK, "block")
    asked, chunks = packed(queries, CHUNK, "chunk")
    asked = asked.select("chunk", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                width = max(row["width"], row["q_width"])
                data = np.pad(np.frombuffer(row["data"], np.int64).reshape(len(ids), -1), ((0, 0), (0, width - row["width"])))
                asks = np.pad(np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), -1), ((0, 0), (0, width - row["q_width"])))
                built = Index(ids, data)
                found = [built.search(int(i), q, k) for i, q in zip(q_ids, asks, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, [len(i) for i, _ in found])),
                        pa.array(np.concatenate([i for i, _ in found])),
                        pa.array(np.concatenate([s for _, s in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    met = index.join(asked, "block").repartition(max(1, min(blocks * chunks, 100_000)), "block", "chunk")
    best = written(met.mapInArrow(run, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

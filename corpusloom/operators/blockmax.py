"""Inverted index in blocks with the largest impact of each, and a search that skips on proof.

Documents are dealt to shards and their chunks numbered inside a shard, in order of chunk id; a span is
``SPAN`` consecutive numbers. A block holds the postings of one term of a tenant in one span, with the
largest term count and the shortest length among them: their weight together bounds the weight of each
posting, whatever the tenant's mean length becomes. Blocks are stored by term bin (a folder each), inside it by
shard (a bucket each), and sorted by term, so a search opens the folders of its own terms and, of few terms,
only their row groups.

A search deals its terms to all shards. There the blocks of a tenant meet a part of its questions; bounds per
(question, span) come from the heads alone, spans are taken by falling bounds, and a question skips a span that cannot
hold one of its n best. Blocks stay in their shards throughout, whatever join Spark picks, and only n rows a question
and shard leave them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.session import bucketed, written

#: Chunks of a span, and folders that terms are dealt to.
SPAN, BINS = 64, 32
#: Shards per bucket, so that buckets differ less in size.
SHARDS = 2
#: Up to so many distinct terms are named to the scan itself.
NAMED_TERMS = 256
#: Questions of a tenant that a task answers together.
QUESTIONS = 256
#: Scores are rounded to six digits after the bounds are drawn.
SLACK = 1e-5

CHUNK = ["tenant_id", "document_id", "chunk_id"]
TQ = ["tenant_id", "query_id"]
HEAD = ["shard", "tenant_id", "term", "span"]


@contextmanager
def co_located_joins(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside leave a side where it lies if it is placed by a part of the join's keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Blocks:
    """Blocks of postings, and the chunk behind each (shard, ord); both in buckets of shards."""

    blocks: DataFrame
    chunks: DataFrame
    shards: int

    def postings(self) -> DataFrame:
        """(chunk, doc_len, term, tf), as the flat index has them."""
        flat = self.blocks.select("shard", "term", F.explode("postings").alias("p"))
        return flat.select("shard", "term", F.col("p.ord").alias("ord"), F.col("p.tf").cast("long").alias("tf")).join(
            self.chunks, ["shard", "ord"]
        ).select(*CHUNK, "doc_len", "term", "tf")


def term_bin(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BINS)).cast("int")


POSTING = "struct<ord: int, tf: int, doc_len: int>"
BLOCK = f"shard int, tenant_id string, term string, span int, max_tf int, min_len int, size int, postings array<{POSTING}>"


def block_rows(rows: pa.Table) -> pa.Table:
    """Blocks of whole spans of chunks (shard, ord, tenant_id, doc_len, tokens) in order."""
    tokens = rows["tokens"].combine_chunks()
    words = tokens.flatten().dictionary_encode()
    chunk = np.repeat(np.arange(rows.num_rows), tokens.value_lengths().to_numpy())
    width = max(1, len(words.dictionary))
    pairs, tf = np.unique(chunk * width + words.indices.to_numpy(), return_counts=True)
    chunk, term = pairs // width, pairs % width

    shard, ord_ = rows["shard"].to_numpy(), rows["ord"].to_numpy()
    tenants = rows["tenant_id"].combine_chunks().dictionary_encode()
    place = np.stack([shard, ord_ // SPAN, tenants.indices.to_numpy()], axis=1)
    places, at = np.unique(place, axis=0, return_inverse=True)
    block = at.reshape(-1)[chunk] * width + term
    # Stable: inside a block the chunks keep their order.
    order = np.argsort(block, kind="stable")
    block, chunk, tf = block[order], chunk[order], tf[order]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(first, append=len(block))
    lens = rows["doc_len"].to_numpy()[chunk]
    postings = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int32)) for x in (ord_[chunk], tf, lens)], names=["ord", "tf", "doc_len"]
    )
    places = places[block[first] // width]
    offsets = pa.array(np.append(first, len(block)).astype(np.int32))

    def ints(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype(np.int32))

    return pa.table(
        {
            "shard": ints(places[:, 0]),
            "tenant_id": tenants.dictionary.take(pa.array(places[:, 2])),
            "term": words.dictionary.take(pa.array(block[first] % width)),
            "span": ints(places[:, 1]),
            "max_tf": ints(np.maximum.reduceat(tf, first) if len(first) else tf),
            "min_len": ints(np.minimum.reduceat(lens, first) if len(first) else lens),
            "size": ints(size),
            "postings": pa.ListArray.from_arrays(offsets, postings),
        }
    )


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks that arrive in order of (shard, ord); a span open at a batch's end waits for the next."""
    open_: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if open_ is None else pa.concat_tables([open_, rows])
        spans = rows["shard"].to_numpy().astype(np.int64) << 32 | rows["ord"].to_numpy() // SPAN
        whole = int(np.searchsorted(spans, spans[-1])) if len(spans) else 0
        open_ = rows.slice(whole)
        if whole:
            yield from block_rows(rows.slice(0, whole)).to_batches()
    if open_ is not None and open_.num_rows:
        yield from block_rows(open_).to_batches()


def stored_blocks(tokens: DataFrame) -> Blocks:
    """Blocks of (chunk, tokens, doc_len), written to the shared folder with one shuffle by shard."""
    buckets = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = buckets * SHARDS
    dealt = tokens.select(
        F.pmod(F.xxhash64("tenant_id", "document_id"), F.lit(shards)).cast("int").alias("shard"), *CHUNK, "tokens", "doc_len"
    ).repartition(buckets, "shard")
    numbered = dealt.withColumn("ord", F.row_number().over(Window.partitionBy("shard").orderBy("chunk_id")) - 1)
    blocks = numbered.select("shard", "ord", "tenant_id", "doc_len", "tokens").mapInArrow(blocks_of, BLOCK)
    return Blocks(
        bucketed(blocks.withColumn("term_bin", term_bin("term")), "shard", partition="term_bin", sort=("term", "tenant_id", "span"), placed=True),
        bucketed(numbered.select("shard", "ord", *CHUNK, "doc_len"), "shard", placed=True),
        shards,
    )


def document_frequency(ix: Blocks) -> DataFrame:
    """Chunks per (tenant, term), summed from the blocks' heads."""
    return ix.blocks.groupBy("tenant_id", "term").agg(F.sum("size").alias("df"))


def asked_blocks(ix: Blocks, asked: DataFrame) -> DataFrame:
    """The blocks that may hold an asked term: folders are chosen by bin, row groups by name where terms are few."""
    terms = asked.select("term").distinct()
    bins = [r[0] for r in terms.select(term_bin("term")).distinct().collect()]
    few = [r["term"] for r in terms.limit(NAMED_TERMS + 1).collect()]
    blocks = ix.blocks.where(F.col("term_bin").isin(bins))
    return blocks.where(F.col("term").isin(few)) if len(few) <= NAMED_TERMS else blocks


def question_blocks(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asked terms with ``qno`` (one per question) and ``part``, and each tenant's number of parts."""
    questions = written(asked.select(*TQ).distinct().withColumn("qno", F.monotonically_increasing_id()))
    parts = questions.groupBy("tenant_id").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("qno"), F.col("parts")).cast("int").alias("part")
    dealt = questions.join(parts, "tenant_id").select(*TQ, "qno", part)
    return dealt, parts


def best_of_block(postings: pa.Table, asked: pa.Table, n: int) -> pa.Table:
    """The n best chunks of each question among a tenant's chunks of one shard.

    Spans are taken by falling bounds; a question leaves out a span that cannot reach its n-th best score so far.
    """
    if not postings.num_rows or not asked.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "qno": pa.array([], pa.int64()), "ord": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
    terms = pc.unique(asked["term"])
    postings = postings.filter(pc.is_in(postings["term"], terms))
    at_term = pc.index_in(postings["term"], terms).to_numpy()
    qnos, at_question = np.unique(asked["qno"].to_numpy(), return_inverse=True)
    gains = np.zeros((len(qnos), len(terms)))
    gains[at_question, pc.index_in(asked["term"], terms).to_numpy()] = asked["gain"].to_numpy()
    flat, slope = asked["flat"][0].as_py(), asked["slope"][0].as_py()

    spans, at_span = np.unique(postings["span"].to_numpy(), return_inverse=True)
    most = np.zeros((len(terms), len(spans)))
    tf = postings["max_tf"].to_numpy().astype(float)
    most[at_term, at_span] = tf / (tf + flat + slope * postings["min_len"].to_numpy())
    bounds = gains @ most

    packed = postings["postings"].combine_chunks()
    sizes, flats = packed.value_lengths().to_numpy(), packed.flatten()
    ords, tfs, lens = (flats.field(i).to_numpy() for i in range(3))
    weights = tfs / (tfs + flat + slope * lens)
    rows = np.repeat(at_term, sizes)
    # Postings of a span lie together.
    order = np.argsort(np.repeat(at_span, sizes), kind="stable")
    ends = np.cumsum(np.bincount(np.repeat(at_span, sizes), minlength=len(spans)))

    best = np.zeros((len(qnos), n))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for span in np.argsort(-bounds.max(axis=0), kind="stable"):
        floor = best.min(axis=1)
        open_ = np.flatnonzero((bounds[:, span] > 0) & (bounds[:, span] >= floor - SLACK))
        if not len(open_):
            continue
        here = order[ends[span - 1] if span else 0 : ends[span]]
        used, at_used = np.unique(rows[here], return_inverse=True)
        chunks, at_chunk = np.unique(ords[here], return_inverse=True)
        each = np.zeros((len(used), len(chunks)))
        each[at_used, at_chunk] = weights[here]
        scores = np.round(gains[np.ix_(open_, used)] @ each, 6)
        best[open_] = -np.partition(-np.concatenate([best[open_], scores], axis=1), n - 1, axis=1)[:, :n]
        q, c = np.nonzero((scores > 0) & (scores >= floor[open_, None]))
        found.append((open_[q], chunks[c], scores[q, c]))
    q, c, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0))
    keep = score >= best.min(axis=1)[q]
    q, c, score = q[keep], c[keep], score[keep]
    # Numbers follow chunk ids, so ties go as they do later.
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, c, score = q[place < n], c[place < n], score[place < n]
    shard = np.full(len(q), asked["shard"][0].as_py(), np.int32)
    return pa.table({"shard": shard, "qno": qnos[q].astype(np.int64), "ord": c.astype(np.int32), "score": score})


def shard_hits(ix: Blocks, asked: DataFrame, questions: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """(shard, qno, ord, score): the n best chunks of each question in each shard."""
    dealt = asked.join(questions, TQ).select("tenant_id", "part", "qno", "term", "gain", "flat", "slope")
    group = ["shard", "tenant_id", "part"]

    def search(postings: pa.Table, terms: pa.Table) -> pa.Table:
        return best_of_block(postings, terms, n)

    blocks = asked_blocks(ix, asked).select(*HEAD, "max_tf", "min_len", "postings")
    shards = F.explode(F.sequence(F.lit(0), F.lit(ix.shards - 1))).alias("shard")
    copies = (
        blocks.join(parts.select("*", shards), ["shard", "tenant_id"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    )
    return (
        copies.groupBy(*group).cogroup(dealt.select("*", shards).groupBy(*group))
        .applyInArrow(search, "shard int, qno long, ord int, score double")
    )


def best_chunks(ix: Blocks, asked: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Every chunk that can be among a question's best, with its exact score.

    ``asked``: (tenant_id, query_id, term, gain, flat, slope). A posting weighs gain * tf / (tf + flat + slope * doc_len),
    which grows with the count and falls with the length; flat and slope are the tenant's.
    """
    questions, parts = question_blocks(asked)
    with co_located_joins(asked.sparkSession):
        found = written(shard_hits(ix, asked, questions, parts, options.candidates))
        named = written(found.join(ix.chunks.drop("tenant_id", "doc_len"), ["shard", "ord"]).join(questions, "qno"))
    return named.select(*CHUNK, "query_id", F.round("score", 6).alias("bm25_score"))


def chunks_with(ix: Blocks, wanted: DataFrame) -> DataFrame:
    """Chunks with at least one of the wanted (tenant, term)."""
    wanted = written(wanted)
    with co_located_joins(wanted.sparkSession):
        shards = F.explode(F.sequence(F.lit(0), F.lit(ix.shards - 1))).alias("shard")
        met = asked_blocks(ix, wanted).join(wanted.select("tenant_id", "term", shards), ["shard", "tenant_id", "term"], "left_semi")
        ords = met.select("shard", F.explode("postings.ord").alias("ord")).distinct()
        return written(ix.chunks.join(ords, ["shard", "ord"], "left_semi").select(*CHUNK))

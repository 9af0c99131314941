"""Chunks packed into blocks where they lie, and a search in bulk that reads each block once.

A block holds up to ``CHUNKS`` chunks of one tenant: its distinct terms, how many of its chunks hold each, and
(chunk, term, count) as numbers. Packing moves no row, sorts nothing and gives what a search of a whole question
table needs: frequencies of the asked terms from the blocks' terms, scores from their counts. An index
(``blockmax``) is worth its sorting where few questions are asked of a stored corpus.

Question blocks of a tenant meet its chunk blocks by a join that Spark plans from their sizes. A task keeps the n best
scores of each question it has met, and passes on only chunks that reach them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.blockmax import question_blocks
from corpusloom.session import written

#: Chunks and terms of a block, at most (a longer chunk is a block of its own), and chunks that a task holds open.
CHUNKS, TERMS, HELD = 2048, 400_000, 32_768
#: Blocks of a row group: Spark writes and reads a group as a whole, and a block takes a few MB.
GROUP = 8
#: Chunks that are scored in one matrix product.
SPAN = 64
#: Question blocks whose best scores a task remembers.
REMEMBERED = 256

CHUNK = ["tenant_id", "document_id", "chunk_id"]
TQ = ["tenant_id", "query_id"]
PACKED = (
    "tenant_id string, documents array<string>, chunks array<string>, lens array<int>, "
    "words array<string>, holding array<int>, counts binary"
)
NAMES = [field.split()[0] for field in PACKED.split(", ")]


def packed_block(rows: pa.Table) -> pa.RecordBatch:
    """One block of chunks of one tenant."""
    tokens = rows["tokens"].combine_chunks()
    words = tokens.flatten().dictionary_encode()
    width = max(1, len(words.dictionary))
    chunk = np.repeat(np.arange(rows.num_rows, dtype=np.int64), tokens.value_lengths().to_numpy())
    pairs, tf = np.unique(chunk * width + words.indices.to_numpy(), return_counts=True)
    chunk, word = pairs // width, pairs % width
    holding = np.bincount(word, minlength=len(words.dictionary)).astype(np.int32)
    data = np.stack([chunk, word, tf]).astype("<i4").tobytes()

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [
        rows["tenant_id"].combine_chunks()[:1],
        *(listed(rows[name].combine_chunks()) for name in ("document_id", "chunk_id", "doc_len")),
        listed(words.dictionary),
        listed(pa.array(holding)),
        pa.array([data], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def packed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks in any order; a block is closed when it is full, all are when a task holds many chunks."""
    held: dict[str, list[pa.Table]] = {}
    terms: dict[str, int] = {}

    def closed(tenant: str) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held.pop(tenant))
        terms.pop(tenant)
        ends, start = np.cumsum(rows["doc_len"].to_numpy().astype(np.int64)), 0
        while start < rows.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + CHUNKS, max(start + 1, int(np.searchsorted(ends, before + TERMS, "right"))))
            yield packed_block(rows.slice(start, stop - start))
            start = stop

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        tenants = batch.column(batch.schema.get_field_index("tenant_id")).dictionary_encode()
        codes = tenants.indices.to_numpy()
        for code, tenant in enumerate(tenants.dictionary.to_pylist()):
            part = rows.take(pa.array(np.flatnonzero(codes == code)))
            held.setdefault(tenant, []).append(part)
            terms[tenant] = terms.get(tenant, 0) + pc.sum(part["doc_len"]).as_py()
            if sum(t.num_rows for t in held[tenant]) >= CHUNKS or terms[tenant] >= TERMS:
                yield from closed(tenant)
        if sum(t.num_rows for parts in held.values() for t in parts) >= HELD:
            for tenant in list(held):
                yield from closed(tenant)
    for tenant in list(held):
        yield from closed(tenant)


def stored_packs(tokens: DataFrame) -> DataFrame:
    """Blocks of (chunk, tokens, doc_len), written to the shared folder without a shuffle."""
    rows = tokens.where("tenant_id is not null").select(*CHUNK, "tokens", F.col("doc_len").cast("int").alias("doc_len"))
    return written(rows.mapInArrow(packed_blocks, PACKED), GROUP)


def document_frequency(packs: DataFrame, terms: DataFrame) -> DataFrame:
    """Chunks per (tenant, term), of the given ones only."""
    each = packs.select("tenant_id", F.explode(F.arrays_zip("words", "holding")).alias("w"))
    held = each.select("tenant_id", F.col("w.words").alias("term"), F.col("w.holding").alias("holding"))
    wanted = written(terms.select("tenant_id", "term").distinct())
    return held.join(wanted, ["tenant_id", "term"]).groupBy("tenant_id", "term").agg(F.sum("holding").alias("df"))


def totals(packs: DataFrame) -> DataFrame:
    """Per tenant: chunks that hold a term and their mean length."""
    lens = packs.select("tenant_id", F.explode("lens").alias("doc_len"))
    return lens.groupBy("tenant_id").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))


def best_of_pack(pack: dict, gains: np.ndarray, terms: pa.Array, flat: float, slope: float, best: np.ndarray):
    """(question, chunk, score) of a block's chunks that are among the n best met so far; ``best`` is brought up to date."""
    n = best.shape[1]
    at_term = pc.index_in(pack["words"], value_set=terms).fill_null(-1).to_numpy()
    chunk, word, tf = np.frombuffer(pack["counts"], "<i4").reshape(3, -1)
    keep = at_term[word] >= 0
    chunk, term, tf = chunk[keep], at_term[word[keep]], tf[keep].astype(float)
    weights = tf / (tf + flat + slope * pack["lens"][chunk])
    found = []
    for start in range(0, len(pack["lens"]), SPAN):
        lo, hi = np.searchsorted(chunk, (start, start + SPAN))
        if lo == hi:
            continue
        used, at_used = np.unique(term[lo:hi], return_inverse=True)
        here, at_here = np.unique(chunk[lo:hi], return_inverse=True)
        each = np.zeros((len(used), len(here)))
        each[at_used, at_here] = weights[lo:hi]
        scores = np.round(gains[:, used] @ each, 6)
        q, c = np.nonzero((scores > 0) & (scores >= best.min(axis=1)[:, None]))
        if not len(q):
            continue
        hit = np.unique(q)
        best[hit] = -np.partition(-np.concatenate([best[hit], scores[hit]], axis=1), n - 1, axis=1)[:, :n]
        found.append((q, here[c], scores[q, c]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = score >= best.min(axis=1)[q]
    q, c, score = q[keep], c[keep], score[keep]
    ids, at = np.unique(c, return_inverse=True)
    names = np.array(pack["chunks"].take(pa.array(ids)).to_pylist(), dtype=str)
    order = np.lexsort((names[at] if len(at) else c, -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < n
    return q[first], c[first], score[first]


def pack_hits(packs: DataFrame, asked: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    """Chunks that are among the n best of a question in their task, with ``qno`` and score."""
    terms = F.collect_list(F.struct("qno", "term", "gain")).alias("asked")
    blocks = asked.join(questions, TQ).groupBy("tenant_id", "part").agg(terms, F.first("flat").alias("flat"), F.first("slope").alias("slope"))
    met = packs.drop("holding").join(written(blocks), "tenant_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                key = (at["tenant_id"].as_py(), at["part"].as_py())
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    entries = at["asked"].values
                    qnos, at_q = np.unique(entries.field("qno").to_numpy(), return_inverse=True)
                    words = entries.field("term").dictionary_encode()
                    gains = np.zeros((len(qnos), len(words.dictionary)))
                    gains[at_q, words.indices.to_numpy()] = entries.field("gain").to_numpy()
                    known[key] = (qnos, words.dictionary, gains, np.zeros((len(qnos), n)))
                qnos, words, gains, best = known[key]
                pack = {"words": at["words"].values, "counts": at["counts"].as_buffer(), "lens": at["lens"].values.to_numpy(), "chunks": at["chunks"].values}
                q, c, score = best_of_pack(pack, gains, words, at["flat"].as_py(), at["slope"].as_py(), best)
                places = pa.array(c)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key[0]] * len(q), pa.string()),
                        at["documents"].values.take(places),
                        at["chunks"].values.take(places),
                        pa.array(qnos[q].astype(np.int64)),
                        pa.array(score),
                    ],
                    names=[*CHUNK, "qno", "score"],
                )

    return met.mapInArrow(run, "tenant_id string, document_id string, chunk_id string, qno long, score double")


def best_chunks(packs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Every chunk that can be among a question's n best, with its exact score; ``asked`` as in ``blockmax.best_chunks``."""
    questions, _ = question_blocks(asked)
    hits = pack_hits(packs, asked, questions, n)
    return hits.join(questions.select("qno", "query_id"), "qno").select(*CHUNK, "query_id", F.round("score", 6).alias("bm25_score"))

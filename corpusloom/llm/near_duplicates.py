"""Near copies by order MinHash, verified by banded alignment.

Texts are sequences of five-word shingles, each labelled with its occurrence number in
the text (a text of fewer words is one shingle). A sketch keeps, for one hash function,
the labelled shingles with the lowest values *in text order*; two texts become candidates
if a sketch agrees. Short texts use sketches of three shingles and longer ones of eight;
the ranges overlap so that texts similar enough to match always share a kind.

Candidates are verified by aligning their labelled shingles. A similarity
m / (n1 + n2 - m) of 0.8, with m aligned shingles, allows (n1 + n2) / 9 unaligned ones, so
no alignment that passes leaves a diagonal band of that width: matches outside the band
are dropped and the longest chain of the rest is the alignment. Labelled shingles are
unique in a text, so the chain takes n log n steps.

Equal word sequences are one node from the start. Every bucket has a hub: its member that
meets most others over all its buckets. Each member is first compared with the hubs of its
buckets, one comparison per member, hub and no more; that joins nearly all of a large group of copies.
Buckets that then still hold several components are searched for links that remain. Members
with the same main hub H bound their overlap: at most the smaller of what each shares with H,
plus the smaller number of shingles outside H that each shares with any member of H. Only
pairs of different components whose bound (or, with different hubs, whose lengths) allows
the similarity are compared, so no candidate pair that could pass is left out.
Components are found by alternating large and small stars over stored tables.

Edge cases: a null text counts as empty; texts without words are copies of each other.
Repeated rows are copies. A class takes the smallest doc_id of its rows; a null doc_id
comes last. Equal hash values of different shingles are as good as impossible (64 bits).
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.common import give_back, likely, only
from corpusloom.session import written

WORDS = 5
SIMILARITY = 0.8
#: (sketches, shingles of a sketch, fewest and most shingles of the texts that use them).
#: Chance to miss a pair at similarity 0.8: under 0.002.
KINDS = ((24, 3, 1, 100), (40, 8, 80, None))
#: Bytes of shingles that a worker keeps of texts it may meet again.
KEPT_BYTES = 32_000_000
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 150_000

STEP = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(7).integers(0, 2**63, sum(k[0] for k in KINDS), np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def labelled(words: list[bytes], known: Hashes | None = None) -> np.ndarray:
    """Hash of each shingle and its occurrence number, in text order."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    look = (Hashes() if known is None else known).__getitem__
    hashes = np.fromiter([look(w) for w in words], np.uint64, n)
    width = min(WORDS, n)
    last = n - width + 1
    out = hashes[:last].copy()
    for k in range(1, width):
        out *= STEP
        out += hashes[k : last + k]
    out = mixed(out + np.uint64(width))
    ordered = np.sort(out)
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(out, kind="stable")
        starts = np.r_[True, out[order][1:] != out[order][:-1]]
        place = np.arange(len(out))
        occurrence = place - np.maximum.accumulate(np.where(starts, place, 0))
        label = np.empty(len(out), np.uint64)
        label[order] = occurrence.astype(np.uint64)
        out = mixed(out + label * STEP)
    return out


def lowest(values: np.ndarray, take: int) -> np.ndarray:
    """Places of the ``take`` lowest values of each row, in text order."""
    n = values.shape[1]
    if n <= take:
        return np.broadcast_to(np.arange(n), values.shape)
    return np.sort(np.argpartition(values, take - 1, axis=1)[:, :take], axis=1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Bucket of every sketch of a text."""
    n, first, out = len(shingles), 0, []
    for sketches, take, fewest, most in KINDS:
        factors = FACTORS[first : first + sketches]
        first += sketches
        if n < fewest or (most and n > most):
            continue
        step = max(1, 200_000 // n)
        for k in range(0, sketches, step):
            part = factors[k : k + step]
            chosen = shingles[lowest(shingles[None, :] * part[:, None], take)]
            bucket = part.copy()
            for j in range(chosen.shape[1]):
                bucket = bucket * STEP + chosen[:, j]
            out.append(mixed(bucket))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketches(text: Column) -> Column:
    """key (16 bytes that tell word sequences apart), n (shingles), buckets."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Hashes()
        for texts in batches:
            keys, sizes, buckets = [], [], []
            for text in texts:
                words = words_of(text.as_py())
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                shingles = labelled(words, known)
                sizes.append(len(shingles))
                buckets.append(sketch(shingles).view(np.int64))
            starts = np.r_[0, np.cumsum([len(b) for b in buckets])].astype(np.int32)
            flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(starts, flat)],
                ["key", "n", "buckets"],
            )
        known.clear()
        give_back()

    return arrow_udf(run, "struct<key: binary, n: bigint, buckets: array<bigint>>")(text)


def chain(places: list[int]) -> int:
    """Length of the longest increasing chain."""
    ends: list[int] = []
    for place in places:
        at = bisect_left(ends, place)
        if at == len(ends):
            ends.append(place)
        else:
            ends[at] = place
    return len(ends)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two texts by banded alignment of their labelled shingles; 0 if under ``SIMILARITY``."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    needed = SIMILARITY / (1 + SIMILARITY) * total - 1e-9
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= total // 9 + 1
    if np.count_nonzero(near) < needed:
        return 0.0
    order = np.argsort(at_a[near])
    places = at_b[near][order]
    m = len(places) if (np.diff(places) > 0).all() else chain(places.tolist())
    return m / (total - m) if m >= needed else 0.0


def squeezed(text: Column) -> Column:
    """The text in UTF-8, compressed for the way to its comparisons."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        press = zstandard.ZstdCompressor().compress
        for texts in batches:
            yield pa.array([press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
        give_back()

    return arrow_udf(run, "binary")(text)


class Shingles(dict):
    """Labelled shingles by compressed text; begun anew when they have grown too large."""

    def __init__(self) -> None:
        self.size, self.known, self.expand = 0, Hashes(), zstandard.ZstdDecompressor().decompress

    def __missing__(self, text: bytes) -> np.ndarray:
        found = labelled(self.expand(text).split(), self.known)
        self.size += found.nbytes + len(text)
        if self.size > KEPT_BYTES:
            self.clear()
            self.size = found.nbytes + len(text)
        self[text] = found
        return found


def compared(left: Column, right: Column, main: Column) -> Column:
    """s: similarity (0 if too low). If ``main``, also common: shingles of both, and others: those of the right text alone.

    Texts come ``squeezed``. What a worker keeps of them ends with the task.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shingles = Shingles()
        for lefts, rights, mains in batches:
            scores, common, others = [], [], []
            for a, b, m in zip(lefts, rights, mains, strict=True):
                x, y = shingles[a.as_py()], shingles[b.as_py()]
                scores.append(aligned(x, y))
                alone = np.setdiff1d(y, x, assume_unique=True) if m.as_py() else None
                common.append(None if alone is None else len(y) - len(alone))
                others.append(None if alone is None else alone.view(np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(common, pa.int64()), pa.array(others, pa.list_(pa.int64()))],
                ["s", "common", "others"],
            )
        shingles.clear()
        shingles.known.clear()
        give_back()

    return arrow_udf(run, "struct<s: double, common: bigint, others: array<bigint>>")(left, right, main)


def with_comparison(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, main) with ``got`` (``compared``). ``texts``: row, text (``squeezed``)."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", compared(F.col("left"), F.col("right"), F.col("main")).alias("got"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every linked node but the smallest ones themselves."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(edges)
    while True:
        # Large star: larger neighbours move to the smallest neighbour. Pairs are (larger, smaller).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        grown = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = grown.groupBy("a").agg(F.min("b").alias("m"))
        moved = grown.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(edges)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now


def linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Components (node, component) of nodes that share buckets and are similar. ``members``: bucket, node, n."""
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    # Most buckets hold one text; their members are ruled out before the join moves any.
    crowd = written(likely(members, "bucket", shared.select("bucket")).join(shared, "bucket"))
    weights = written(crowd.groupBy("node").agg(F.sum("size").alias("weight")))
    # Only texts that share a bucket are ever compared.
    texts = written(only(texts, "row", weights.select("node")).select("row", squeezed(F.col("text")).alias("text")))
    weighed = written(crowd.join(weights, "node").select("bucket", "node", "n", "weight"))
    best = F.max(F.struct("weight", (-F.col("node")).alias("first"))).alias("hub")
    hubs = weighed.groupBy("bucket").agg(best).select("bucket", (-F.col("hub.first")).alias("hub"), F.col("hub.weight").alias("hub_weight"))
    stars = weighed.join(hubs, "bucket").where("node <> hub").select("hub", "hub_weight", "node").distinct()
    main = stars.groupBy("node").agg(F.max(F.struct("hub_weight", (-F.col("hub")).alias("first"))).alias("main"))
    stars = stars.join(main, "node").select(F.col("hub").alias("a"), F.col("node").alias("b"), (F.col("hub") == -F.col("main.first")).alias("main"))
    first = written(with_comparison(stars, texts))
    links = first.where("got.s > 0").select("a", "b")
    found = components(links)

    # What each node shares with its main hub, and how much of the rest some other node of that hub has too.
    own = first.where("got.common is not null").select(F.col("a").alias("hub"), F.col("b").alias("node"), "got.common", "got.others")
    alone = (
        own.select("hub", "node", F.explode("others").alias("shingle"))
        .groupBy("hub", "shingle").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
        .groupBy("node").agg(F.count("*").alias("alone"))
    )
    known = own.join(alone, "node", "left").select("node", "hub", "common", (F.size("others") - F.coalesce("alone", F.lit(0))).alias("rest"))

    placed = weighed.select("bucket", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    left_over = written(placed.join(several.select("bucket"), "bucket").join(known, "node", "left"))
    r, q = left_over.alias("r"), left_over.alias("q")
    needed = SIMILARITY / (1 + SIMILARITY) * (F.col("r.n") + F.col("q.n")) - 1e-6
    alike = F.least("r.n", "q.n") >= SIMILARITY * F.greatest("r.n", "q.n") - 1e-6
    most = F.least("r.common", "q.common") + F.least("r.rest", "q.rest")
    bounded = F.coalesce((F.col("r.hub") != F.col("q.hub")) | (most >= needed), F.lit(True))
    on = (F.col("r.bucket") == F.col("q.bucket")) & (F.col("r.node") < F.col("q.node")) & (F.col("r.component") != F.col("q.component"))
    pairs = r.join(q, on & alike & bounded).select(F.col("r.node").alias("a"), F.col("q.node").alias("b"), F.lit(False).alias("main")).distinct()
    pairs = written(pairs)
    texts = only(texts, "row", pairs.select(F.explode(F.array("a", "b")).alias("row")))
    more = written(with_comparison(pairs, texts).where("got.s > 0").select("a", "b"))
    return found if more.isEmpty() else components(links.union(more))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (as struct ``doc``) with row numbers and sketches, stored; and for each word sequence its class.

    The second table has key, class_id and keep (the row that stands for the class).
    """
    stored = written(
        docs.select(
            F.struct(*docs.columns).alias("doc"), sketches(F.col("text")).alias("sketch"), F.monotonically_increasing_id().alias("row")
        )
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    nodes = written(
        stored.select("doc.doc_id", "row", F.col("sketch.key").alias("key")).groupBy("key").agg(F.min("row").alias("node"), first)
    )
    slim = stored.select(F.col("row").alias("node"), F.col("sketch.n").alias("n"), F.col("sketch.buckets").alias("buckets"))
    members = only(slim, "node", nodes.select("node")).select(F.explode("buckets").alias("bucket"), "node", "n")
    found = linked(members, stored.select("row", "doc.text"))
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first").alias("best"))
    classes = named.join(firsts, "component").select("key", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("keep"))
    return stored, written(classes)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its group)."""
    stored, named = grouped(docs.select("doc_id", "text"))
    return stored.select("doc.doc_id", F.col("sketch.key").alias("key")).join(named, "key").select("doc_id", "class_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group, with all columns of ``docs``."""
    stored, named = grouped(docs)
    return only(stored, "row", named.select("keep").distinct()).select("doc.*")

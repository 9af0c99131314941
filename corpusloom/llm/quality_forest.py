"""Quality rules with an isolation forest on rule statistics.

The base rule fails documents of fewer than ten words or with more than 20 % of
their words in repeated five-word windows. For the others an isolation forest judges
eight shares: symbols and capital letters of all characters, bars and exclamation marks
per word, words in repeated windows, repeated lines, the commonest word, and how far the different
words fall short of all. All but the last are damped for short texts. The labelled rows give each share a cut
that tells them apart with least mistakes, at most ``LOST`` of the clean ones; a share is counted in steps of 0.01 from its cut, so that
clean texts share one place that no split can tear apart.

The forest is grown on at most ``SAMPLE`` labelled rows, those of lowest hash; its
threshold is the middle of the widest range that separates the labelled rows with
least mistakes, counted in Spark over all labelled rows.

Edge cases: a null text has no words and fails the base rule. Repeated rows are judged row
by row. A repeated label counts once, with its lowest value. Without labelled rows
of both kinds only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.llm import textstats
from corpusloom.session import written

#: Bound on the labelled rows that grow the forest.
SAMPLE = 4096
TREES = 200
PER_TREE = 256
DEPTH = 8
STEP = 0.01
#: Where no labelled poor text bounds a cut from above, it is the next multiple of this beyond the clean ones.
COARSE = 0.05
#: Share of the clean labelled rows that may lie beyond a cut.
LOST = 0.01
#: Characters and words by which shares of short texts are damped.
DAMP_CHARS, DAMP_WORDS = 100, 20
BINS = 1000
RULES = ("symbols", "upper", "bars", "exclamations", "repeated", "duplicate_lines", "top_word", "distinct")
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20


V = TypeVar("V")


@dataclass(frozen=True)
class Tree:
    """Nodes in one array; a leaf has rule -1 and its path length in ``cut``."""

    rule: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    per_tree: int


def unsuccessful(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def share(rule: str, words: V, chars: V, x: V) -> V:
    """A rule's share, damped for short texts; numbers, arrays or columns alike."""
    if rule == "distinct":
        return 1 - x
    return x * (chars / (chars + DAMP_CHARS) if rule in ("symbols", "upper") else words / (words + DAMP_WORDS))


def levels(counts: np.ndarray, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rule shares in whole steps from their cuts, 0 below. ``counts``: n_words and word_chars of each row."""
    words, chars = counts[:, 0], counts[:, 1]
    shares = np.stack([share(r, words, chars, x[:, textstats.FEATURES.index(r)]) for r in RULES], axis=1)
    return np.maximum(np.floor((shares - cuts) / STEP) + 1, 0)


def grow(points: np.ndarray, rng: np.random.Generator) -> Tree:
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, depth: int) -> int:
        place = len(nodes)
        nodes.append([-1, depth + unsuccessful(len(rows)), 0, 0])
        low, high = rows.min(0), rows.max(0)
        rules = np.flatnonzero(high > low)
        if depth < DEPTH and len(rows) > 1 and len(rules):
            rule = int(rng.choice(rules))
            cut = rng.uniform(low[rule], high[rule])
            below = rows[:, rule] <= cut
            nodes[place] = [rule, cut, node(rows[below], depth + 1), node(rows[~below], depth + 1)]
        return place

    node(points, 0)
    rule, cut, left, right = np.array(nodes, float).T
    return Tree(rule.astype(int), cut, left.astype(int), right.astype(int))


def plant(points: np.ndarray, seed: int = 0) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(PER_TREE, len(points))
    return Forest(tuple(grow(points[rng.choice(len(points), size, replace=False)], rng) for _ in range(TREES)), size)


def anomaly(forest: Forest, points: np.ndarray) -> np.ndarray:
    """Anomaly score in 0 to 1 of each row: shorter mean paths score higher."""
    different, inverse = np.unique(points, axis=0, return_inverse=True)
    total = np.zeros(len(different))
    for tree in forest.trees:
        at = np.zeros(len(different), int)
        while (inner := np.flatnonzero(tree.rule[at] >= 0)).size:
            here = at[inner]
            low = different[inner, tree.rule[here]] <= tree.cut[here]
            at[inner] = np.where(low, tree.left[here], tree.right[here])
        total += tree.cut[at]
    return 2.0 ** (-total / len(forest.trees) / max(unsuccessful(forest.per_tree), 1e-9))[inverse.ravel()]


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED_PERCENT * stats["n_words"])


def score(forest: Forest, cuts: np.ndarray, stats: Column) -> Column:
    def run(words: pa.Array, chars: pa.Array, x: pa.Array) -> pa.Array:
        counts = np.stack([words.to_numpy(zero_copy_only=False), chars.to_numpy(zero_copy_only=False)], axis=1)
        rows = np.asarray(x.flatten()).reshape(len(x), len(textstats.FEATURES))
        return pa.array(anomaly(forest, levels(counts, rows, cuts)) if len(rows) else np.zeros(0), pa.float64())

    return arrow_udf(run, "double")(stats["n_words"], stats["word_chars"], stats["x"])


def tallied(counts: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Clean and poor rows by bin. counts: rows by (bin, quality)."""
    clean, poor = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for (place, quality), n in counts.items():
        (clean if quality == 1 else poor)[place] += n
    return clean, poor


def widest(wrong: np.ndarray) -> np.ndarray:
    """The widest range of places with the fewest mistakes."""
    best = np.flatnonzero(wrong == wrong.min())
    return max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)


def separating(counts: dict[tuple[int, int], int]) -> float:
    """Middle of the widest range of thresholds with the fewest mistakes. counts: rows by (bin, quality)."""
    clean, poor = tallied(counts)
    found = widest(clean[::-1].cumsum()[::-1] + np.r_[0, poor.cumsum()[:-1]])
    return float((found[0] + found[-1]) / 2 / BINS)


def cut_of(counts: dict[tuple[int, int], int]) -> float:
    """Where a share begins to count. counts: labelled rows by (bin, quality)."""
    clean, poor = tallied(counts)
    lost = np.r_[clean[::-1].cumsum()[::-1], 0]
    wrong = lost + np.r_[0, poor.cumsum()]
    found = widest(np.where(lost <= LOST * clean.sum(), wrong, np.inf))
    if found[-1] > BINS:
        return float(np.ceil(found[0] / BINS / COARSE) * COARSE)
    return float((found[0] + found[-1]) / 2 / BINS)


def learnt_cuts(rows: DataFrame) -> np.ndarray:
    """Cuts in the order of ``RULES``, from counts over all labelled rows. rows: quality, stats."""
    s = F.col("stats")
    at = textstats.FEATURES.index
    places = [F.floor(share(r, s["n_words"], s["word_chars"], s["x"][at(r)]) * BINS) for r in RULES]
    placed = F.array(*(F.greatest(F.lit(0), F.least(F.lit(BINS), p)).cast("int") for p in places))
    counted = rows.select("quality", F.posexplode(placed).alias("rule", "place")).groupBy("rule", "place", "quality").count().collect()
    by_rule: list[dict[tuple[int, int], int]] = [{} for _ in RULES]
    for r in counted:
        by_rule[r.rule][r.place, r.quality] = r["count"]
    return np.array([cut_of(c) for c in by_rule])


def fit(measured: DataFrame, labels: DataFrame) -> tuple[Forest, np.ndarray, float] | None:
    """Forest, cuts and threshold from labelled rows that pass the base rule; None without both labels."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = written(
        measured.where(~base_failed(F.col("stats"))).select("doc_id", "stats").join(marks, "doc_id").select("doc_id", "quality", "stats")
    )
    kinds = {r.quality for r in rows.select("quality").distinct().collect()}
    if not {0, 1} <= kinds:
        return None
    sample = rows.select("stats", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "stats.x").limit(SAMPLE).collect()
    counts = np.array([[r.stats.n_words, r.stats.word_chars] for r in sample])
    cuts = learnt_cuts(rows)
    forest = plant(levels(counts, np.array([r.stats.x for r in sample]), cuts))
    place = F.floor(score(forest, cuts, F.col("stats")) * BINS).cast("int").alias("place")
    binned = rows.select("quality", place).groupBy("place", "quality").count().collect()
    return forest, cuts, separating({(r.place, r.quality): r["count"] for r in binned})


def judge(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, anomaly, kept, and the columns in ``keep``.

    ``training``: the documents that ``labels`` describe, if they are not ``docs`` themselves.
    """
    kept = [c for c in keep if c != "doc_id"]
    measure = textstats.column(F.col("text")).alias("stats")
    learnt = written((docs if training is None else training).select("doc_id", measure))
    rows = docs.select("doc_id", *kept, measure) if training is not None or kept else learnt
    found = fit(learnt, labels.select("doc_id", "quality"))
    stats = F.col("stats")
    out = rows.select(
        "doc_id",
        *kept,
        *(stats[c].alias(c) for c in textstats.COUNTS),
        base_failed(stats).alias("base_failed"),
        (score(found[0], found[1], stats) if found else F.lit(0.0)).alias("anomaly"),
    )
    limit = found[2] if found else 1.0
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))

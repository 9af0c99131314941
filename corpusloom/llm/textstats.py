"""Rule statistics of whole texts, shared by the quality rules and the quality classifier.

A word is a maximal run of characters other than space, tab, line feed, vertical
tab, form feed and carriage return. A null text has no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.common import give_back

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
MARKS = b".,;:"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "symbols",
    "bars",
    "exclamations",
    "upper",
    "digits",
    "marks",
    "repeated",
    "duplicate_lines",
    "distinct",
    "top_word",
    "word_length",
    "line_length",
)

WINDOW = 5
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.random.default_rng(5).integers(0, 2**63, 4096, np.uint64)


def numbered(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Words as numbers in order of first appearance, and how many there are."""
    numbers: dict[bytes, int] = {}
    add = numbers.setdefault
    return np.fromiter([add(w, len(numbers)) for w in words], np.int64, len(words)), len(numbers)


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside five-word windows that occur twice or more in the text, the first one included.

    Different hashes prove different windows. Where two hashes agree, windows are compared
    exactly: pairs, then fours, then fives of word numbers are numbered in turn.
    """
    n = len(ids)
    if n <= WINDOW or kinds > n - WINDOW:  # too few repeated words for a repeated window
        return 0
    mixed = MIX[ids % len(MIX)] + ids.astype(np.uint64) * STEP
    last = n - WINDOW + 1
    hashes = mixed[:last].copy()
    for k in range(1, WINDOW):
        hashes *= STEP
        hashes += mixed[k : last + k]
    hashes.sort()
    if not (hashes[1:] == hashes[:-1]).any():  # different hashes: different windows
        return 0
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    if pairs.max() == len(pairs) - 1:
        return 0
    fours = np.unique(pairs[:-2] * len(pairs) + pairs[2:], return_inverse=True)[1]
    if fours.max() == len(fours) - 1:
        return 0
    fives = fours[:-1] * kinds + ids[WINDOW - 1 :]
    _, inverse, times = np.unique(fives, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[inverse] > 1)
    covered = np.zeros(n + 1, np.int64)
    covered[starts] += 1
    np.subtract.at(covered, starts + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def measure(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The counts named in ``COUNTS`` and the features named in ``FEATURES`` of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    white = without(data, WHITE)
    chars = len(text or "") - white
    symbols = without(data, SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.translate(None, WHITE)]
    duplicates = len(lines) - len(set(lines))
    ids, kinds = numbered(words)
    repeated = repeated_words(ids, kinds)
    counts = (n, chars, symbols, duplicates, repeated)
    if not n:
        return counts, [0.0] * len(FEATURES)
    top = int(np.bincount(ids).max())
    return counts, [
        math.log1p(n),
        symbols / chars,
        data.count(b"|") / n,
        data.count(b"!") / n,
        without(data, UPPER) / chars,
        without(data, DIGITS) / chars,
        without(data, MARKS) / n,
        repeated / n,
        duplicates / len(lines),
        math.log1p(kinds) / math.log1p(n),
        top / n,
        chars / n,
        math.log1p(n / len(lines)),
    ]


SCHEMA = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", x: array<double>>"


def column(text: Column) -> Column:
    """``measure`` of a text column as a struct; only the text travels to Python, in Arrow batches."""

    def measured(texts: pa.Array) -> pa.Array:
        done = [measure(t) for t in texts.to_pylist()]
        counts = np.array([c for c, _ in done], np.int64).reshape(len(done), len(COUNTS))
        flat = np.array([x for _, x in done], float).ravel()
        starts = np.arange(len(done) + 1, dtype=np.int32) * len(FEATURES)
        parts = [pa.array(counts[:, k]) for k in range(len(COUNTS))]
        return pa.StructArray.from_arrays([*parts, pa.ListArray.from_arrays(starts, flat)], [*COUNTS, "x"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield measured(texts)
        give_back()

    return arrow_udf(run, SCHEMA)(text)

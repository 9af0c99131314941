"""Pack tokenised documents into sequences by best-fit decreasing.

A document's tokens are its text's ids and an end id; only documents longer than a sequence
are cut, into whole sequences and a rest. Pieces are dealt by hash into groups of a
bounded size; each group is packed alone, longest piece first, into the open sequence
with the least room that still holds it. A segment tree over remaining capacities finds
that sequence in logarithmic time. A group of so many pieces leaves at most a few
sequences open, so packing groups apart costs next to nothing, and no task sees more
than one group.

Ids of a white-space separated word do not depend on its neighbours (the tokenizer
drops white space before it splits), so each worker keeps the ids of words it has met, in a
store of bounded size, and only new words reach the tokenizer.

Edge cases: a null text is empty; an empty text is one piece that holds the end id
alone. Repeated rows are packed as often as they occur. Equal lengths are taken by
(doc_id, piece, row). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm.common import give_back
from corpusloom.session import written

CAPACITY = 4096
END_ID = 1
#: Pieces of a group, about.
GROUP = 150_000
#: Words whose ids a worker keeps.
KNOWN_WORDS = 300_000
#: Bytes of text whose new words are learnt together.
BATCH_BYTES = 4_000_000
#: Words that the tokenizer is given at once; what it returns takes far more memory than the ids.
ENCODED_WORDS = 5_000
#: Bytes of ids that are passed on at once.
PASSED_BYTES = 4_000_000


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, word by word.

    The tokenizer lowers its text, so ASCII letters are lowered before words are looked up, except
    where a text might hold a special token. A full stop or comma behind an ASCII letter or digit
    is a pre-token of its own. Words met lately are kept when the store is begun anew.
    """

    def __init__(self, path: str, known: int | None = None, batch: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.batch = known or KNOWN_WORDS, batch or BATCH_BYTES
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.marks = {m: self._encoded([m])[0] for m in (b".", b",")}

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, from one call on all of them as lines."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        found = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(found)), starts) * 4
        data = np.array(found.ids, "<u4").tobytes()
        return [data[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, words: set[bytes]) -> None:
        """Make all ``words`` known."""
        missing = words - self.known.keys()
        if len(self.known) + len(missing) > self.most:
            self.before, self.known, missing = self.known, {}, words
        known, before = self.known, self.before
        marked, new = [], set()
        for word in missing:
            if (found := before.get(word)) is not None:
                known[word] = found
                continue
            if word[-1:] in self.marks and word[-2:-1].isalnum() and b"<|" not in word:
                marked.append(word)
                word = word[:-1]
                if (found := before.get(word)) is not None:
                    known[word] = found
            if word not in known:
                new.add(word)
        if new:
            ordered = list(new)
            for k in range(0, len(ordered), ENCODED_WORDS):
                part = ordered[k : k + ENCODED_WORDS]
                known.update(zip(part, self._encoded(part), strict=True))
        for word in marked:
            known[word] = known[word[:-1]] + self.marks[word[-1:]]

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; new words of many texts are learnt at once."""
        k = 0
        while k < len(texts):
            split, size, words = [], 0, set()
            while k < len(texts) and size < self.batch:
                data = (texts[k] or "").encode("utf-8", "surrogatepass")
                split.append((data if b"<|" in data else data.lower()).split())
                words.update(split[-1])
                size += len(data)
                k += 1
            self.learn(words)
            for each in split:
                yield b"".join(map(self.known.__getitem__, each))


@lru_cache(maxsize=1)
def ids_of(path: str, known: int | None = None, batch: int | None = None) -> Ids:
    return Ids(path, known, batch)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    keep: tuple[str, ...] = (),
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    known: int | None = None,
    batch_bytes: int | None = None,
) -> DataFrame:
    """doc_id, the columns in ``keep``, piece, start, length, ids (binary, 4 bytes each).

    ``tokenizer`` is the path of a vocabulary file that every executor has. ``known`` words stay in a worker's store and
    the new words of ``batch_bytes`` of text are learnt together; fewer take less memory and more time, never other ids.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]

    def run(batches):
        ids = ids_of(tokenizer, known, batch_bytes)
        for batch in batches:
            at, piece, data, size = [], [], [], 0
            for k, whole in enumerate(ids.of(batch.column("text").to_pylist())):
                whole += end
                for j, start in enumerate(range(0, len(whole), step)):
                    at.append(k)
                    piece.append(j)
                    data.append(whole[start : start + step])
                size += len(whole)
                if size > PASSED_BYTES:
                    yield made(batch, at, piece, data)
                    at, piece, data, size = [], [], [], 0
            yield made(batch, at, piece, data)
        give_back()

    def made(batch, at, piece, data):
        rows = batch.select(names).take(pa.array(at, pa.int64()))
        starts = [j * capacity for j in piece]
        lengths = [len(x) // 4 for x in data]
        extra = [pa.array(piece, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays([*rows.columns, *extra], [*names, "piece", "start", "length", "ids"])

    source = docs.select(*names, *([] if "text" in names else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*names).schema)
    return source.mapInArrow(run, f"{schema}, piece int, start long, length long, ids binary")


class Capacities:
    """Segment tree over remaining capacities: how many open sequences have each."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence with the least room of at least ``need``, with its room."""
        node = self.leaves + need
        counts = self.counts
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node ^ 1]):
                node >>= 1
            if node == 1:
                return None
            node ^= 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += by
            node >>= 1


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths come longest first."""
    tree, sequences, offsets, used = Capacities(capacity), [], [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found, used = (used, capacity), used + 1
        sequence, room = found
        sequences.append(sequence)
        offsets.append(capacity - room)
        tree.put(room - length, sequence)
    return sequences, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``cut`` (doc_id, piece, length and small columns) with sequence_id and offset."""
    placed = written(cut.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-placed.count() // GROUP))
    names = [c for c in placed.columns if c != "row"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        sequences, offsets = best_fit(rows["length"].tolist(), capacity)
        return rows[names].assign(sequence_id=[s * groups + group for s in sequences], offset=offsets)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*names).schema)
    dealt = placed.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary): the packed sequences themselves, from pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))

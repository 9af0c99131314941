"""Token counts of documents under a unigram vocabulary, by dynamic programming over a trie.

A text's pre-tokens are its words behind a word mark. Each worker inserts the different
pre-tokens it meets in a trie. The forward score of a node (the best sum of piece scores
over segmentations of the prefix it stands for, and how many tokens that takes) depends on
its ancestors alone, so it is computed once for all pre-tokens that share the prefix;
the last node of a pre-token holds its count. Documents are sums of these counts. Nothing is
shuffled; a trie that has grown to ``NODES`` nodes is begun anew.

The vocabulary is a sentencepiece file that lists pieces by rank; a piece of rank r scores
-log((r + 1) * sum of 1/k), the frequency that Zipf's law gives it. A character outside the
vocabulary costs ``UNKNOWN`` more than the rarest piece and counts one token for each
of its bytes. Equal scores: fewer tokens.

Edge cases: a null or empty text has no pre-tokens. Rows are counted one by one, so repeated
ids and null ids keep their rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MARK = "▁"
UNKNOWN = 10.0
#: Nodes that a worker's trie may have.
NODES = 400_000


def zipf_pieces(path: str) -> dict[str, float]:
    """Score of each piece of a sentencepiece file, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    usual = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    usual.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / k for k in range(1, len(usual) + 1)))
    return {model.id_to_piece(i): -math.log(rank) - norm for rank, i in enumerate(usual, 1)}


class Trie:
    """Forward scores of prefixes. Node 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """Number of tokens of a pre-token."""
        path, node = [0], 0
        for i, letter in enumerate(word, 1):
            child = self.children.get((node, letter))
            if child is None:
                child = self._forward(path, word, i)
                self.children[node, letter] = child
            path.append(child)
            node = child
        return self.count[node]

    def _forward(self, path: list[int], word: str, end: int) -> int:
        best, tokens = -math.inf, 0
        get, score, count = self.pieces.get, self.score, self.count
        for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
            piece = get(word[start:end])
            if piece is None:
                if start != end - 1:
                    continue
                piece, extra = self.unknown, len(word[start].encode("utf-8", "surrogatepass"))
            else:
                extra = 1
            before = path[start]
            total, n = score[before] + piece, count[before] + extra
            if total > best or (total == best and n < tokens):
                best, tokens = total, n
        score.append(best)
        count.append(tokens)
        return len(score) - 1

    def tokens(self, words: list[bytes]) -> int:
        terminal, total = self.terminal, 0
        for word in words:
            n = terminal.get(word)
            if n is None:
                if len(self.score) > NODES:
                    self.clear()
                    terminal = self.terminal
                terminal[word] = n = self.insert(MARK + word.decode("utf-8", "surrogatepass"))
            total += n
        return total


@lru_cache(maxsize=1)
def trie_of(path: str) -> Trie:
    return Trie(zipf_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens.

    ``vocabulary`` is the path of a sentencepiece file that every executor has.
    """

    def run(texts: pa.Array) -> pa.Array:
        trie = trie_of(vocabulary)
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([len(w) for w in words], pa.int64()), pa.array([trie.tokens(w) for w in words], pa.int64())], ["n_pretokens", "n_tokens"]
        )

    counts = arrow_udf(run, "struct<n_pretokens: bigint, n_tokens: bigint>")(F.col("text"))
    return docs.select("doc_id", counts.alias("counts")).select("doc_id", "counts.n_pretokens", "counts.n_tokens")

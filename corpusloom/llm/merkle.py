"""Merkle manifest of a dataset whose parents keep copies of their hash state.

A node is the SHA-256 of its children's digests (hexadecimal text), three to a node. A
parent that hashes its children keeps a copy of the state before each child slot.
Folding a changed child upwards resumes the copy before its slot, hashes the new digest and
the siblings to its right, and never touches those to its left again.

At scale: leaves are numbered inside their group by a range sort and offsets per task, so a
group that holds most rows is spread over many tasks. A round cuts each group into blocks
of 3 ** 7 nodes and reduces every block to one node; a group of n leaves takes log(n) to
that base rounds (three for ten thousand million), each 2,187 times smaller than the one before. Going
back down, a block is told its path: the digests left and right of it at every level
above. A state cannot leave its process, so the task hashes the left digests of its path once and
copies that state for every leaf of the block. The groups' subroots form the top tree by the same rounds.

Edge cases: a null group is a group and comes first; a null or repeated leaf id has its place by
(id, digest), null first, and rows equal in both may take each other's places. Null and empty values
have different digests, texts of any length are hashed in the JVM. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import written

#: Children of a node, and levels that one task reduces.
WIDTH, LEVELS = 3, 7
SPAN = WIDTH**LEVELS


def leaf_digest(*columns: str) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and the value; null as a dash."""

    def part(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in columns)).cast("binary"), 256)


# --------------------------------------------------------------------------- one block, in a task


def levels_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * WIDTH
    return levels


class Block:
    """The subtree over consecutive nodes: digests of every level, and each parent's states."""

    def __init__(self, digests: list[bytes], levels: int) -> None:
        self.nodes = [digests]
        #: states[level][node]: the state of the node's parent before the node's slot.
        self.states: list[list] = []
        for _ in range(levels):
            below, kept, above = self.nodes[-1], [], []
            for first in range(0, len(below), WIDTH):
                state = hashlib.sha256()
                for digest in below[first : first + WIDTH]:
                    kept.append(state.copy())
                    state.update(digest)
                above.append(state.hexdigest().encode())
            self.states.append(kept)
            self.nodes.append(above)

    def sides(self, level: int, node: int) -> tuple[bytes, bytes]:
        """Digests to the left and right of a node under its parent."""
        row, first = self.nodes[level], node - node % WIDTH
        return b"".join(row[first:node]), b"".join(row[node + 1 : first + WIDTH])

    def path(self, node: int) -> list[tuple[bytes, bytes]]:
        out = []
        for level in range(len(self.states)):
            out.append(self.sides(level, node))
            node //= WIDTH
        return out

    def fold(self, node: int, digest: bytes) -> bytes:
        """Digest of the block's top with ``digest`` in the place of a bottom node."""
        for level, states in enumerate(self.states):
            state = states[node].copy()
            state.update(digest)
            state.update(self.sides(level, node)[1])
            digest = state.hexdigest().encode()
            node //= WIDTH
        return digest


class Above:
    """The way from a block's top to the root: one state and the right siblings per level."""

    def __init__(self, path: list[tuple[str, str]]) -> None:
        self.siblings = "".join(left + right for left, right in path).encode()
        self.steps = [(hashlib.sha256(left.encode()), right.encode()) for left, right in path]

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


# --------------------------------------------------------------------------- rounds in Spark

NODE = "grp string, pos long, digest string, levels int"
PATH = "array<struct<l: string, r: string>>"


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos``, their place in ``grp`` from 0, and ``n``, the rows of the group.

    Rows are sorted by ranges, counted per (task, group), and shifted by the counts of the tasks before.
    """
    # A stored row number splits rows that are equal in every other column.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in ("grp", *order, "_row")]
    placed = written(
        written(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    task = F.shiftright("_at", 33)
    runs = placed.groupBy("grp", task.alias("_task")).agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    group = Window.partitionBy("grp")
    shifts = runs.select(
        "grp", "_task", F.sum("_rows").over(group).alias("n"),
        (F.sum("_rows").over(group.orderBy("_task")) - F.col("_rows") - F.col("_from")).alias("_shift"),
    )
    return (
        placed.withColumn("_task", task).join(shifts, ["grp", "_task"])
        .withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift", "_row")
    )


def blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {SPAN}"))


def subtree(rows: pd.DataFrame) -> tuple[pd.DataFrame, Block]:
    rows = rows.sort_values("pos")
    return rows, Block([d.encode() for d in rows["digest"]], min(int(rows["levels"].iloc[0]), LEVELS))


def risen(nodes: DataFrame) -> DataFrame:
    """One round: the top node of every block; its group has up to ``LEVELS`` levels fewer to go."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows, tree = subtree(rows)
        first = rows.iloc[0]
        return pd.DataFrame(
            {"grp": [first["grp"]], "pos": [first["block"]], "digest": [tree.nodes[-1][0].decode()],
             "levels": [int(first["levels"]) - len(tree.states)]}
        )

    return blocks(nodes).groupBy("grp", "block").applyInPandas(top, NODE)


@dataclass(frozen=True)
class Tree:
    """Nodes of every round (the last holds one node per group), and the rounds' paths."""

    rounds: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.rounds[-1].select("grp", "digest")

    def paths(self) -> DataFrame:
        """(grp, pos, path) of the nodes of the second round: what lies beside the way up from each block."""
        paths = self.rounds[-1].select("grp", "pos", F.array().cast(PATH).alias("path"))
        for nodes in reversed(self.rounds[1:-1]):
            paths = written(descended(nodes, paths))
        return paths


def descended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of a round's nodes from those of the blocks that hold them."""

    def walk(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, tree = subtree(rows)
        rest = [(s["l"], s["r"]) for s in top["path"].iloc[0]]
        paths = [
            [{"l": left, "r": right} for left, right in [(a.decode(), b.decode()) for a, b in tree.path(i)] + rest]
            for i in range(len(rows))
        ]
        return pd.DataFrame({"grp": rows["grp"], "pos": rows["pos"], "path": paths})

    tops = above.withColumnRenamed("pos", "block").groupBy("grp", "block")
    return blocks(nodes).groupBy("grp", "block").cogroup(tops).applyInPandas(walk, f"grp string, pos long, path {PATH}")


def tree_over(leaves: DataFrame) -> Tree:
    """The tree over numbered leaves (grp, pos, n, digest), as many rounds as the largest group takes."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = F.lit(0)
    for level in range(1, levels_of(most) + 1):
        levels = F.when(F.col("n") > WIDTH ** (level - 1), level).otherwise(levels)
    rounds = [leaves.withColumn("levels", levels.cast("int"))]
    for _ in range(max(1, -(-levels_of(most) // LEVELS))):
        rounds.append(written(risen(rounds[-1])))
    return Tree(rounds)


@dataclass(frozen=True)
class Manifest:
    """Leaves with their places, the trees of the groups, and the tree over their subroots."""

    leaves: DataFrame
    groups: Tree
    top: Tree


def manifest(leaves: DataFrame) -> Manifest:
    """Manifest of (group, id, digest, ...); other columns stay with the leaves."""
    named = leaves.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))).drop("group")
    placed = written(numbered(named, "id", "digest"))
    groups = tree_over(placed)
    tops = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest")
    return Manifest(placed, groups, tree_over(written(numbered(tops, "member"))))


def ways(made: Manifest) -> DataFrame:
    """(grp, block, subroot, root, path) of every bottom block: its path leads to the root of all."""
    over = descended(made.top.rounds[0].select("grp", "pos", "digest", "levels"), made.top.paths())
    tops = made.top.rounds[0].select("grp", "pos", "member", F.col("digest").alias("subroot"))
    groups = (
        over.join(tops, ["grp", "pos"]).join(made.top.roots.withColumnRenamed("digest", "root"), "grp")
        .select(F.col("member").alias("grp"), "subroot", "root", F.col("path").alias("_over"))
    )
    return made.groups.paths().join(groups, "grp").select(
        "grp", F.col("pos").alias("block"), "subroot", "root", F.concat("path", "_over").alias("path")
    )


PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(made: Manifest) -> DataFrame:
    """Each leaf's proof, and the root that its ``presented`` digest folds to."""

    def prove(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, tree = subtree(rows)
        way = top.iloc[0]
        above = Above([(s["l"], s["r"]) for s in way["path"]])
        # Siblings on the way up from each node, shared by its children.
        beside = [above.siblings]
        for level in reversed(range(len(tree.states))):
            beside = [b"".join(tree.sides(level, i)) + beside[i // WIDTH] for i in range(len(tree.nodes[level]))]
        folded = [above.fold(tree.fold(i, d.encode())).decode() for i, d in enumerate(rows["presented"])]
        return pd.DataFrame(
            {"id": rows["id"].astype("Int64"), "leaf": rows["digest"], "subroot": way["subroot"], "root": way["root"],
             "proof_sha256": [hashlib.sha256(b).hexdigest() for b in beside], "folded_root": folded,
             "verified": [f == way["root"] for f in folded]}
        )

    leaves = blocks(made.groups.rounds[0]).select("grp", "block", "pos", "levels", "id", "digest", "presented")
    return leaves.groupBy("grp", "block").cogroup(ways(made).groupBy("grp", "block")).applyInPandas(prove, PROOF)


def verified_rows(docs: DataFrame) -> DataFrame:
    """Manifest of documents, and its check against texts that lost their line feeds where 2 divides the id's checksum."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    named = docs.select(*columns)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bare = F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    whole, changed = leaf_digest(*columns), leaf_digest(*columns[:-1], "_bare")
    leaves = named.withColumn("_bare", bare).select(
        F.col("source").alias("group"), F.col("doc_id").alias("id"), whole.alias("digest"), changed.alias("presented")
    )
    return proofs(manifest(leaves)).withColumnRenamed("id", "doc_id")

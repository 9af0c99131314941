"""Prefix trie of conversations by peeling turns off their ends.

A node is a distinct sequence of first turns. The trie is found from its deepest level upwards: at
depth d the conversations that end there and the nodes that survive from depth d + 1, their last turn
stripped, are grouped by what is left. The same grouping adds up members, children, leaves and
saved text, so a level is complete when it is found and nothing is visited twice.

A turn is the digest of its role and text and the length of its text; a prefix is a chain of such digests,
so no text is shuffled. Levels with many rows are one grouping each, with partial sums in every
task, so a prefix shared by a third of all rows arrives as one row per task. The few conversations
that are longer than the rest would cost a job for every turn: levels whose rows together are at most
``BAND`` entries are peeled in one job, grouped by the node at the band's foot.

The ids that end at a node are hashed in order: ranges of (node, id) are joined to segments in
parallel, and one task per node only reads its segments through, holding one batch at a time. A
node's parent is named by a join; the fewer than a thousand parents that hold more than a thousandth of all
nodes as children are broadcast, so no join key is hot.

Edge cases: a null role or text is empty. Turns go by number (null first), then role, then digest, so
repeated turn numbers have one order and repeated rows stay repeated. A null conv_id is no
conversation. A conversation without turns belongs to the root alone. An empty table gives no node.
Texts of any length are hashed in the JVM. Other columns are ignored. One conversation's turns must fit
into a task's memory as digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written

#: Entries (rows times levels) that one job peels at once; a task holds no more of them.
BAND = 10_000
#: Tasks of such a job; subtrees are dealt out by the node at the band's foot.
BAND_TASKS = 8
#: Parents with more than this share of all nodes as children are told by broadcast.
HEAVY = 1000

PATH = "array<struct<id: binary, chars: long>>"
#: What arrives at a level: a prefix with the sums of what lies under it.
ARRIVED = ("path", "conv", "n", "children", "leaves", "saved")
NODE = f"conv long, depth long, key binary, parent binary, n long, children long, leaves long, saved long, path {PATH}"
NODE_COLUMNS = [part.strip().split(" ")[0] for part in NODE.split(", ")[:8]] + ["path"]


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order, each as digest and length."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", role.alias("role"), digest(said).alias("id"), F.length(text).cast("long").alias("chars"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    return conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(turns.alias("turns"))


def regrown(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their hundred.

    How many, is the checksum of the id modulo ``most``; the rest are the conversation's own turns after as many.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("_head", F.array().cast("array<struct<id: binary, chars: long>>")), F.lit(1), h)
    return convs.withColumn("_base", base).join(heads, "_base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def chained(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, path): the nodes from the root to the conversation's end."""
    root = F.array(F.struct(digest(F.lit("")).alias("id"), F.lit(0).cast("long").alias("chars")))
    path = F.aggregate(
        "turns",
        root.cast(PATH),
        lambda path, t: F.concat(
            path,
            F.array(F.struct(digest(F.concat(F.element_at(path, -1)["id"], t["id"])).alias("id"), t["chars"].alias("chars"))),
        ),
    )
    return convs.select("conv_id", F.size("turns").cast("long").alias("depth"), path.alias("path"))


# --------------------------------------------------------------------------- peeling


def bands(lengths: dict[int, int], most: int = BAND) -> list[tuple[int, int, bool]]:
    """(highest depth, depth below the lowest, small enough for one job), from the deepest level to the root."""
    out, alive, at = [], 0, max(lengths, default=-1)
    while at >= 0:
        top, entries = at, 0
        while at >= 0:
            here = alive + lengths.get(at, 0)
            if entries + here > most and at < top:
                break
            alive, entries, at = here, entries + here, at - 1
        out.append((top, at, entries <= most))
    return out


def level(arrived: DataFrame, depth: int) -> DataFrame:
    """All nodes of one depth from the prefixes that arrive there."""
    last = F.element_at("path", -1)
    grouped = (
        arrived.withColumn("key", last["id"]).groupBy("key")
        .agg(F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.any_value("path").alias("path"))
    )
    parent = F.element_at("path", -2)["id"] if depth else F.lit(None).cast("binary")
    return grouped.select(
        "conv", F.lit(depth).cast("long").alias("depth"), "key", parent.alias("parent"), "n", "children",
        F.greatest("leaves", F.lit(1)).cast("long").alias("leaves"),
        (F.col("saved") + (F.col("n") - 1) * last["chars"]).alias("saved"), "path",
    )


def band(arrived: DataFrame, high: int, low: int) -> DataFrame:
    """All nodes of the depths ``low + 1`` to ``high``, the subtrees of nodes at the band's foot each in one task."""

    def peel(rows: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[int, list[list]] = {}
        for row in rows[list(ARRIVED)].itertuples(index=False):
            waiting.setdefault(len(row[0]) - 1, []).append([list(row[0]), *map(int, row[1:])])
        out = []
        for depth in range(high, low, -1):
            nodes: dict[bytes, list] = {}
            for path, conv, *sums in waiting.pop(depth, ()):
                node = nodes.setdefault(bytes(path[-1]["id"]), [path, conv, 0, 0, 0, 0])
                node[1] = min(node[1], conv)
                node[2:] = [a + b for a, b in zip(node[2:], sums)]
            for key, (path, conv, n, children, leaves, saved) in nodes.items():
                leaves, saved = max(leaves, 1), saved + (n - 1) * int(path[-1]["chars"])
                parent = bytes(path[-2]["id"]) if depth else None
                out.append((conv, depth, key, parent, n, children, leaves, saved, path if depth == low + 1 else None))
                waiting.setdefault(depth - 1, []).append([path[:-1], conv, n, 1, leaves, saved])
        return pd.DataFrame(out, columns=NODE_COLUMNS)

    foot = F.pmod(F.xxhash64(F.element_at("path", low + 2)["id"]), F.lit(BAND_TASKS))
    return arrived.groupBy(foot).applyInPandas(peel, NODE)


def stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth as what arrives at the depth above, their last turn gone."""
    return nodes.where(F.col("depth") == depth).select(
        F.slice("path", 1, depth).alias("path"), "conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved"
    )


def peeled(paths: DataFrame) -> DataFrame:
    """Every node of the trie over (conv_id, depth, path)."""
    lengths = {r["depth"]: r["count"] for r in paths.groupBy("depth").count().collect()}
    zero = F.lit(0).cast("long")
    ended = paths.select(
        "depth", "path", F.col("conv_id").alias("conv"), F.lit(1).cast("long").alias("n"), zero.alias("children"),
        zero.alias("leaves"), zero.alias("saved"),
    )
    found: list[DataFrame] = []
    for high, low, small in bands(lengths):
        arrived = ended.where((F.col("depth") > low) & (F.col("depth") <= high)).select(*ARRIVED)
        if found:
            arrived = arrived.unionByName(stripped(found[-1], high + 1))
        found.append(written(band(arrived, high, low) if small else level(arrived, high)))
    if not found:
        return paths.sparkSession.createDataFrame([], NODE).drop("path")
    out = found[0]
    for nodes in found[1:]:
        out = out.unionByName(nodes)
    return out.drop("path")


# --------------------------------------------------------------------------- names and ends


def with_parents(nodes: DataFrame, count: int) -> DataFrame:
    """Adds ``parent_conv``, the smallest member of each node's parent."""
    parents = nodes.where("children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), "children")
    many = F.col("children") > count // HEAVY
    heavy = parents.where(many).select("parent", F.col("parent_conv").alias("_heavy"))
    met = nodes.join(F.broadcast(heavy), "parent", "left")
    plain = met.where("_heavy IS NULL AND parent IS NOT NULL").drop("_heavy")
    named = met.where("_heavy IS NOT NULL OR parent IS NULL").withColumnRenamed("_heavy", "parent_conv")
    return plain.join(parents.where(~many).drop("children"), "parent").unionByName(named)


def end_digests(paths: DataFrame) -> DataFrame:
    """(key, ends): digest of the comma-joined ids, in order, of the conversations that end at a node."""
    ends = paths.select(F.element_at("path", -1)["id"].alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = rows["conv_id"].astype(str).groupby(rows["key"], sort=False).agg(",".join)
            firsts = rows.groupby("key", sort=False)["conv_id"].min()
            yield pd.DataFrame({"key": ids.index, "first": firsts.to_numpy(), "ids": ids.to_numpy()})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for rows in batches:
            done = []
            for key, ids in zip(rows["key"], rows["ids"]):
                if key == at:
                    state.update(f",{ids}".encode())
                    continue
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends"])
        if state is not None:
            yield pd.DataFrame([(at, state.hexdigest())], columns=["key", "ends"])

    segments = ends.mapInPandas(joined, "key binary, first long, ids string")
    return segments.repartition("key").sortWithinPartitions("key", "first").mapInPandas(hashed, "key binary, ends string")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, turns), one row per node."""
    # In order of depth, so that a level reads only its own row groups.
    paths = written(chained(convs).orderBy("depth", "conv_id"))
    nodes = written(peeled(paths))
    named = with_parents(nodes, nodes.count())
    nothing = hashlib.sha256(b"").hexdigest()
    return named.join(end_digests(paths), "key", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )

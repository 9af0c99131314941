"""Vectors: hashing embedder, exact and cell-probing search, pair scores, model guard."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import text as T
from corpusloom.session import written

DIM = 64
MODEL = "hashing-64"
# Vectors of a block of chunks, and of questions; two blocks meet in one matrix product.
CHUNK_BLOCK, QUESTION_BLOCK = 2048, 512
# Rows of best chunks that a task keeps before it passes them on.
MAX_KEPT = 500_000


# --------------------------------------------------------------------------- embedding


def _bucket_sums(tokens: pa.Array) -> pa.Array:
    """Scatter-add of signed term hashes, one matrix per Arrow batch; a term of a batch is hashed once.

    The hash is the number that seven hex digits of the term's digest write.
    """
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = tokens.flatten().dictionary_encode()
    digests = (hashlib.md5(w.as_py().encode()).hexdigest() for w in words.dictionary)
    codes = np.fromiter((int(d[:7], 16) for d in digests), np.int64, len(words.dictionary))
    places, signs = codes % DIM, 1.0 - 2.0 * ((codes // DIM) % 2)
    at = words.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.bincount(row * DIM + places[at], weights=signs[at], minlength=len(sizes) * DIM)
    offsets = pa.array(np.arange(0, len(flat) + 1, DIM, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.float32)))


def embed_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Adds the default embedding of lists of terms: whole-number bucket sums, cosine-ready.

    Only the terms go to Python, a batch at a time; the other columns stay in the JVM.
    """
    return df.withColumn("embedding", F.arrow_udf(_bucket_sums, "array<float>")(F.col(tokens)))


def embed_chunks(df: DataFrame, source: str = "text") -> DataFrame:
    """Adds the default embedding of a text's terms."""
    return embed_tokens(T.with_tokens(df, source, "_tokens"), "_tokens").drop("_tokens")


def embed_with(
    df: DataFrame, factory: Callable[[], object], source: str = "text", batch_size: int = 16
) -> DataFrame:
    """Adds embeddings from a user model.

    ``factory`` builds an object with ``embed(list[str]) -> ndarray`` once per
    Python worker; texts go in small batches, one vector per text, same order.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(source)).to_pylist()
            vectors: list = []
            for start in range(0, len(texts), batch_size):
                part = np.asarray(model.embed(texts[start : start + batch_size]), dtype=np.float32)
                if len(part) != len(texts[start : start + batch_size]):
                    raise ValueError("the model must return one vector per text")
                vectors.extend(part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, type=pa.list_(pa.float32()))],
                names=[*batch.schema.names, "embedding"],
            )

    return df.mapInArrow(run, schema + ", embedding array<float>")


# --------------------------------------------------------------------------- cosine


def cosine(left: Column, right: Column) -> Column:
    """Cosine clipped to 0..1; 0 for missing, empty, zero or unequal vectors."""
    wide = "array<double>"
    left, right = left.cast(wide), right.cast(wide)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(left, right, lambda a, b: a * b))
    norms = F.sqrt(total(F.transform(left, lambda a: a * a))) * F.sqrt(
        total(F.transform(right, lambda b: b * b))
    )
    usable = (F.size(left) > 0) & (F.size(left) == F.size(right))
    ratio = F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norms)))
    return F.coalesce(F.when(usable, ratio), F.lit(0.0))


def cosine_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.withColumn("cosine", F.round(cosine(F.col(left), F.col(right)), 6))


def _unit(listed: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length ``dim`` as unit rows (zero for a zero vector), and the places of those."""
    sizes = np.diff(listed.offsets.to_numpy())
    fits = np.flatnonzero(sizes == dim)
    flat = listed.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    rows = flat[starts[fits][:, None] + np.arange(dim)] if len(fits) else np.zeros((0, dim))
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0), fits


def _blocks(df: DataFrame, group: str, key: str, kind: str, size: int, name: str) -> DataFrame:
    """Vectors packed where they lie: one row per search group, vector length and up to ``size`` vectors.

    ``dim`` -1 holds the keys of vectors that are missing; they are packed without numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def packed(at: tuple) -> pa.RecordBatch:
            parts = held.pop(at)
            keys = pa.concat_arrays([k for k, _ in parts])
            data = np.concatenate([v for _, v in parts]).astype(np.float64).tobytes()
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int32()), lists, pa.array([data], pa.binary())],
                [group, "dim", f"{name}_keys", f"{name}_data"],
            )

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            codes = groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            listed = batch.column(2)
            sizes = np.where(listed.is_null().to_numpy(zero_copy_only=False), -1, np.diff(listed.offsets.to_numpy()))
            for code, dim in {*zip(codes.tolist(), sizes.tolist(), strict=True)}:
                if code < 0 or (dim < 1 and name == "q"):
                    continue
                rows = np.flatnonzero((codes == code) & (sizes == dim))
                part = listed.take(pa.array(rows))
                unit = _unit(part, dim)[0] if dim > 0 else np.zeros((len(rows), 0))
                at = (groups.dictionary[code].as_py(), max(dim, 0))
                held.setdefault(at, []).append((batch.column(1).take(pa.array(rows)), unit))
                if sum(len(k) for k, _ in held[at]) >= size:
                    yield packed(at)
        for at in list(held):
            yield packed(at)

    schema = f"{group} string, dim int, {name}_keys array<{kind}>, {name}_data binary"
    return df.select(group, key, "embedding").mapInArrow(run, schema)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row, ties by id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near].astype(str), -scores[near]))[:k]]


def _block_best(k: int, group: str):
    """A matrix product per pair of blocks; a task keeps the k best chunks of each question it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            counts = [len(ids) for ids, _ in best.values()]
            record = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([g for g, _ in best], object), counts), pa.string()),
                    pa.array(np.repeat(np.array([q for _, q in best], np.int64), counts), pa.int64()),
                    pa.array(np.concatenate([i for i, _ in best.values()]), pa.string()),
                    pa.array(np.concatenate([s for _, s in best.values()]), pa.float64()),
                ],
                names=[group, "query_id", "chunk_id", "score"],
            )
            best.clear()
            return record

        for batch in batches:
            for row in range(batch.num_rows):
                at = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                ids = np.array(at["c_keys"].values.to_pylist(), object)
                asked = at["q_keys"].values.to_numpy(zero_copy_only=False)
                wide, dim = at["q_dim"].as_py(), at["c_dim"].as_py()
                if wide == dim:
                    chunk = np.frombuffer(at["c_data"].as_buffer(), np.float64).reshape(len(ids), dim)
                    question = np.frombuffer(at["q_data"].as_buffer(), np.float64).reshape(len(asked), dim)
                    scores = np.round(np.clip(question @ chunk.T, 0.0, 1.0), 6)
                else:
                    scores = np.zeros((len(asked), len(ids)))
                name = at[group].as_py()
                for query, line in zip(asked.tolist(), scores, strict=True):
                    near = _top(line, ids, k)
                    found, held = ids[near], line[near]
                    if (name, query) in best:
                        before = best[name, query]
                        found, held = np.concatenate((before[0], found)), np.concatenate((before[1], held))
                        keep = _top(held, found, k)
                        found, held = found[keep], held[keep]
                    best[name, query] = (found, held)
                if len(best) * k > MAX_KEPT:
                    yield out()
        if best:
            yield out()

    return run


def local_topk(chunks: DataFrame, queries: DataFrame, k: int, group: str = "tenant_id") -> DataFrame:
    """Best k chunks per question and task, within the search group.

    Both sides are packed into blocks where they lie; blocks of a group meet by a join
    that Spark plans from their sizes, and a task multiplies two blocks at a time.
    """
    asked = _blocks(queries, group, "query_id", "bigint", QUESTION_BLOCK, "q").withColumnRenamed("dim", "q_dim")
    stored = _blocks(chunks, group, "chunk_id", "string", CHUNK_BLOCK, "c").withColumnRenamed("dim", "c_dim")
    met = stored.join(written(asked), group)
    return met.mapInArrow(_block_best(k, group), f"{group} string, query_id long, chunk_id string, score double")


def cosine_topk(
    chunks: DataFrame, queries: DataFrame, options: Options = DEFAULTS, k: int | None = None
) -> DataFrame:
    """Exact search: per question the k nearest chunks of its tenant, ties by chunk id."""
    n = k or options.candidates
    w = Window.partitionBy("tenant_id", "query_id").orderBy(F.col("score").desc(), "chunk_id")
    local = local_topk(chunks, queries, n)
    return local.withColumn("vector_rank", F.row_number().over(w)).filter(F.col("vector_rank") <= n)


def cell_of(tenant: str, number: str) -> Column:
    """A search group: the number of a cell within a tenant."""
    return F.concat_ws("#", number, tenant)


def ann_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    cells: int = 16,
    probes: int = 4,
    seed: int = 7,
) -> DataFrame:
    """Approximate search: vectors fall into k-means cells, a question probes the nearest.

    Each task only multiplies a cell's vectors with the questions probing it; a
    crowded cell is spread over as many tasks as hold its rows, since vectors
    are never moved.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))

    model = KMeans(k=cells, seed=seed, maxIter=5, featuresCol="_v", predictionCol="_cell").fit(vectors(chunks))
    placed = model.transform(vectors(chunks)).select(
        cell_of("tenant_id", "_cell").alias("cell"), "chunk_id", "embedding"
    )
    centers = [c.tolist() for c in model.clusterCenters()]  # `cells` rows, fixed
    distances = F.array(
        *[
            F.struct(
                F.aggregate(
                    F.zip_with(
                        F.col("embedding").cast("array<double>"),
                        F.array(*[F.lit(x) for x in c]),
                        lambda a, b: (a - b) * (a - b),
                    ),
                    F.lit(0.0),
                    lambda acc, x: acc + x,
                ).alias("d"),
                F.lit(i).alias("i"),
            )
            for i, c in enumerate(centers)
        ]
    )
    near = F.slice(F.sort_array(distances), 1, probes)
    probing = queries.select(
        "tenant_id", "query_id", "embedding", F.explode(F.transform(near, lambda s: s["i"])).alias("_cell")
    ).select(cell_of("tenant_id", "_cell").alias("cell"), "query_id", "embedding")
    # The number stands first and holds no mark, so a tenant may hold any.
    local = local_topk(placed, probing, k, "cell").withColumn("tenant_id", F.expr("substring(cell, locate('#', cell) + 1)"))
    w = Window.partitionBy("tenant_id", "query_id").orderBy(F.col("score").desc(), "chunk_id")
    return (
        local.withColumn("vector_rank", F.row_number().over(w))
        .filter(F.col("vector_rank") <= k)
        .select("tenant_id", "query_id", "chunk_id", "score", "vector_rank")
    )


def with_cosine(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """True cosine of each hit with its question; a missing vector scores 0."""
    stored = chunks.select("tenant_id", "chunk_id", F.col("embedding").alias("_stored"))
    asked = queries.select("tenant_id", "query_id", F.col("embedding").alias("_asked"))
    joined = hits.join(stored, ["tenant_id", "chunk_id"], "left").join(asked, ["tenant_id", "query_id"])
    return cosine_pairs(joined, "_asked", "_stored").drop("_asked", "_stored")


def score_lexical_only(
    bm25_hits: DataFrame, vector_hits: DataFrame, chunks: DataFrame, queries: DataFrame
) -> DataFrame:
    """The chunks only BM25 found, with their true cosine."""
    key = ["tenant_id", "query_id", "chunk_id"]
    only = bm25_hits.select(*key).join(vector_hits.select(*key), key, "left_anti")
    return with_cosine(only, chunks, queries)


def embedding_model_guard(stored: DataFrame) -> DataFrame:
    """Per tenant the models and vector sizes in store; more than one is a conflict."""
    return stored.groupBy("tenant_id").agg(
        F.array_join(F.sort_array(F.collect_set("embedding_model")), ",").alias("models"),
        F.array_join(
            F.sort_array(F.collect_set(F.size("embedding").cast("string"))), ","
        ).alias("sizes"),
        (
            (F.size(F.collect_set("embedding_model")) > 1)
            | (F.size(F.collect_set(F.size("embedding"))) > 1)
        ).alias("conflict"),
    )


def assert_one_model(incoming: DataFrame, model: str) -> None:
    """Reject a write that would mix vectors of different models."""
    other = incoming.filter(F.col("embedding_model") != model).select("embedding_model").limit(1).collect()
    if other:
        raise ValueError(f"collection holds model {model!r}, incoming rows use {other[0][0]!r}")

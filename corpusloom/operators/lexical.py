"""BM25 over an inverted index: postings, statistics, search.

A stored index keeps its postings in blocks (``blockmax``), where a search reads only spans that can
matter and moves its own terms and the cut rows, never a posting. Flat postings, such as a stream's
deltas fold to, are joined and summed by chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import text as T
from corpusloom.operators import blockmax, packed
from corpusloom.session import written

CHUNK = ["tenant_id", "document_id", "chunk_id"]
TQ = ["tenant_id", "query_id"]


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks that hold at least one term, with their terms and length."""
    if "tokens" not in chunks.columns:
        chunks = T.with_tokens(chunks.select(*CHUNK, "text"), "text")
    return chunks.select(*CHUNK, "tokens", F.size("tokens").alias("doc_len")).filter("doc_len > 0")


def query_terms(questions: DataFrame) -> DataFrame:
    """Distinct terms of each question."""
    terms = T.with_tokens(questions.select(*TQ, "question"), "question")
    return terms.select(*TQ, F.explode(F.array_distinct("tokens")).alias("term"))


@dataclass(frozen=True)
class Index:
    """Postings (term, chunk, tf, doc_len), document frequencies, and totals per tenant; blocks if stored."""

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    blocks: blockmax.Blocks | None = None


@dataclass(frozen=True)
class Packs:
    """Chunks in blocks without an index: what a search of a whole question table needs."""

    packs: DataFrame


def bm25_postings(tokens: DataFrame) -> DataFrame:
    """(term, chunk, tf) with the chunk's length.

    A chunk's terms sit in one row, so the map-side combine already yields final counts.
    """
    exploded = tokens.select(*CHUNK, "doc_len", F.explode("tokens").alias("term"))
    return exploded.groupBy(*CHUNK, "doc_len", "term").agg(F.count("*").alias("tf"))


def inverted_index(tokens: DataFrame) -> Index:
    postings = bm25_postings(tokens)
    return Index(postings, document_frequency(postings), corpus_totals(tokens))


def stored_index(tokens: DataFrame) -> Index:
    """The index written to the shared folder, postings in blocks."""
    blocks = blockmax.stored_blocks(tokens)
    return Index(blocks.postings(), written(blockmax.document_frequency(blocks)), written(corpus_totals(tokens)), blocks)


def stored_packs(tokens: DataFrame) -> Packs:
    return Packs(packed.stored_packs(tokens))


def corpus_totals(tokens: DataFrame) -> DataFrame:
    """Per tenant: chunks in the index and their mean length."""
    return tokens.groupBy("tenant_id").agg(
        F.count("*").alias("n"), F.avg("doc_len").alias("avg_len")
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("tenant_id", "term").agg(F.count("*").alias("df"))


def term_parts(options: Options = DEFAULTS) -> tuple[Column, float, Column]:
    """Rarity of a term, and what a chunk weighs its count against: a constant and a factor of its length."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf, options.k1 * (1 - options.b), options.k1 * options.b / F.col("avg_len")


def term_weight(options: Options = DEFAULTS) -> Column:
    """Contribution of one term to one chunk."""
    idf, flat, slope = term_parts(options)
    return idf * (F.col("tf") * (options.k1 + 1) / (F.col("tf") + flat + slope * F.col("doc_len")))


def bm25_scores(index: Index | Packs, terms: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Score of every chunk that can be among a question's best.

    The terms asked for, with their frequencies, are written once, so the planner knows
    their size when it chooses how they meet the postings.
    """
    whole = isinstance(index, Packs)
    frequencies = packed.document_frequency(index.packs, terms) if whole else index.frequencies
    totals = packed.totals(index.packs) if whole else index.totals
    asked = written(terms.join(frequencies, ["tenant_id", "term"]).join(totals, "tenant_id"))
    idf, flat, slope = term_parts(options)
    parts = (((options.k1 + 1) * idf).alias("gain"), F.lit(flat).alias("flat"), slope.alias("slope"))
    if whole:
        return packed.best_chunks(index.packs, asked.select(*TQ, "term", *parts), options.candidates)
    if index.blocks is not None:
        return blockmax.best_chunks(index.blocks, asked.select(*TQ, "term", *parts), options)
    return (
        index.postings.join(asked, ["tenant_id", "term"])
        .select("tenant_id", "document_id", "chunk_id", "query_id", term_weight(options).alias("weight"))
        .groupBy("tenant_id", "document_id", "chunk_id", "query_id")
        .agg(F.round(F.sum("weight"), 6).alias("bm25_score"))
    )


def top_n(scores: DataFrame, score: str, rank: str, n: int) -> DataFrame:
    """Best n per question, ties by chunk id; tasks keep only n rows per question to shuffle."""
    w = Window.partitionBy(*TQ).orderBy(F.col(score).desc(), "chunk_id")
    return scores.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def bm25_search(index: Index | Packs, questions: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Top chunks of each question by BM25."""
    scores = bm25_scores(index, query_terms(questions), options)
    return top_n(scores, "bm25_score", "bm25_rank", options.candidates)


def lexical_score(hits: DataFrame) -> DataFrame:
    """BM25 relative to the best of the same question."""
    best = F.max("bm25_score").over(Window.partitionBy(*TQ))
    return hits.withColumn(
        "lexical_score", F.when(best > 0, F.col("bm25_score") / best).otherwise(F.lit(0.0))
    )


def contains_any_token(index: Index, wanted: DataFrame) -> DataFrame:
    """Chunks with at least one of the wanted (tenant, term)."""
    if index.blocks is not None:
        return blockmax.chunks_with(index.blocks, wanted)
    return index.postings.join(wanted, ["tenant_id", "term"], "left_semi").select(*CHUNK).distinct()


def index_size(index: Index) -> DataFrame:
    """Indexed chunks and distinct terms per tenant."""
    terms = index.frequencies.groupBy("tenant_id").agg(F.count("*").alias("terms"))
    return index.totals.select("tenant_id", F.col("n").alias("chunks")).join(terms, "tenant_id")

"""Registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    html_text,
    impact_search,
    merkle,
    mixing,
    near_duplicates,
    packing,
    preferences,
    prefix_trie,
    pu_quality,
    quality_forest,
    textstats,
    trie_counts,
    url_rules,
    warc,
)
from corpusloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_forest.judge(docs, labels).select("doc_id", *textstats.COUNTS, "base_failed", "kept", "anomaly")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")

    def sides(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("conv_id", "pair_id")

    made = preferences.preference_examples(sides(turns), sides(preferences.swapped_replies(turns)))

    def runs(mask: str):
        return F.array_join(F.transform(mask, lambda r: F.concat_ws(":", r["chars"], r["trained"])), ",").alias(mask)

    return made.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", runs("chosen_mask"), runs("rejected_mask"))


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return trie_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = impact_search.sound_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return impact_search.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pu_quality.classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))


#: The stated rules of the URL query.
STATED = [
    url_rules.Stated("allow", "com", "/"),
    url_rules.Stated("block", "example.com", "/en/"),
    url_rules.Stated("allow", "www.example.com", "/en/"),
    url_rules.Stated("block", "net", "/es/"),
    url_rules.Stated("block", "net", "/fr/"),
]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filtered(table(spark, sf_dir, "pages", "page_id", "url"), STATED)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.regrown(prefix_trie.gathered(turns)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_host_paths,
        op2_quality_forest,
        op3_preference_format,
        op4_trie_token_counts,
        op5_order_minhash,
        op6_impact_search,
        op7_source_mix,
        op8_best_fit_packing,
        op9_pu_quality,
        op10_warc_revisits,
        op11_url_rules,
        op12_prefix_trie,
        op13_merkle_manifest,
    )
}

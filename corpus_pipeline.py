"""Training-data pipeline over ``documents``: quality, rules, near copies, source mix, packing.

Each stage reads the rows that the stage before wrote. All but the last return rows of
``documents``; the mix repeats a document as often as it takes it. What a stage stores
on its way is deleted when the next one begins, since its result has been written by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, near_duplicates, packing, pu_quality, quality_forest
from corpusloom.llm.common import prepare, table
from corpusloom.session import drop_tables, recorded_tables, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a worker of the packing keeps, and bytes of text learnt together: little, beside an executor that earlier stages have filled.
KNOWN_WORDS, BATCH_BYTES = 50_000, 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stage before has stored.
_STORED: list[str] = []


def stage(run: Stage) -> Stage:
    @wraps(run)
    def alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _STORED)
        with recorded_tables() as paths:
            out = run(prepare(spark), docs, sf_dir)
        _STORED.extend(paths)
        return out

    return alone


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return pu_quality.classify(docs, labels, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the forest, which learns from the labelled documents of the corpus."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    corpus = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_forest.judge(docs, labels, training=corpus, keep=COLUMNS).where("kept").select(*COLUMNS)


@stage
def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return near_duplicates.first_of_each(docs.select(*COLUMNS))


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mixing.mix(docs, keep=COLUMNS).where("taken > 0")
    times = F.expr("sequence(1, cast(taken div size as int))")
    return mixed.withColumn("time", F.explode(times)).select(*COLUMNS)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in the packed sequences."""
    words = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(docs.select("doc_id", "text"), words, known=KNOWN_WORDS, batch_bytes=BATCH_BYTES)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicate_removal", near_duplicate_removal),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the forest; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

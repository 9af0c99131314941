"""Ingestion: uploaded files to indexed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.config import DEFAULTS, Options
from corpusloom.operators import chunking, prepare
from corpusloom.plans import workload as w


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.document_metadata(w.corpus_pages(spark, sf_dir))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.document_metadata(w.corpus_pages(spark, sf_dir), w.sidecars(spark, sf_dir))


def prepare_chunks(
    pages: DataFrame, confirmed: DataFrame | None, options: Options = DEFAULTS
) -> DataFrame:
    """Usable pages to chunks with header and metadata."""
    return described_chunks(pages, prepare.document_metadata(pages, confirmed, options), options)


def described_chunks(pages: DataFrame, meta: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Usable pages to chunks with header and the given metadata."""
    usable = prepare.page_text_gate(pages, options)
    return chunking.chunk_headers(chunking.chunk_pages(usable, options), meta)


def indexed_chunks(spark: SparkSession, sf_dir: str, options: Options = DEFAULTS) -> DataFrame:
    return prepare_chunks(w.corpus_pages(spark, sf_dir), w.sidecars(spark, sf_dir), options)

"""Registered queries: scans, filters, document preparation, structural chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.operators import chunking, prepare
from corpusloom.plans import ingestion as ing
from corpusloom.plans import workload as w
from corpusloom.plans.registry import query

KEY = ["tenant_id", "document_id", "page"]


@query
def scan_corpus_parquet(spark, d):
    return w.table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query
def tenant_scope(spark, d):
    return w.raw_documents(spark, d).filter("tenant_id = 'src3'").select("doc_id", "tenant_id", "filename")


@query
def page_text_gate(spark, d):
    return prepare.page_text_gate(w.raw_pages(spark, d)).select("doc_id", "page", F.length("text").alias("chars"))


@query
def extraction_quality(spark, d):
    return prepare.extraction_quality(w.corpus_pages(spark, d))


@query
def question_filter(spark, d):
    q = w.table(spark, d, "benchmark").filter(F.length("text").between(3, 2000))
    return q.select("item_id", T.strip(F.col("text")).alias("question"))


@query
def flag_injection(spark, d):
    flagged = prepare.flag_injection(w.raw_pages(spark, d))
    return flagged.groupBy("tenant_id").agg(
        F.count("*").alias("pages"), F.count_if("flagged").alias("flagged_pages")
    )


@query
def drop_empty_metadata(spark, d):
    meta = ing.metadata(spark, d)
    fields = ["authority", "effective_date", "source_url", "document_version", "status"]
    mapped = meta.select(
        "tenant_id",
        "document_id",
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c) for c in fields])
        ).alias("metadata"),
    )
    kept = prepare.drop_empty_metadata(mapped)
    return kept.select(
        "tenant_id",
        "document_id",
        F.array_join(F.sort_array(F.map_keys("metadata")), ",").alias("keys"),
        F.array_join(F.sort_array(F.map_values("metadata")), ",").alias("values"),
    )


@query
def status_label(spark, d):
    meta = ing.metadata(spark, d)
    return meta.select("tenant_id", "document_id", "status", T.status_label(F.col("status")).alias("label"))


@query
def content_identity(spark, d):
    return w.raw_documents(spark, d).select("doc_id", "tenant_id", "content_hash", "document_id")


@query
def exact_duplicate_docs(spark, d):
    return w.unique_documents(spark, d).select("tenant_id", "document_id", "doc_id", "filename")


@query
def normalize_text(spark, d):
    return w.table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query
def normalize_lines(spark, d):
    return w.raw_pages(spark, d).select("doc_id", "page", T.normalize_lines(F.col("text")).alias("normalized"))


@query
def frontmatter_split(spark, d):
    docs = w.raw_documents(spark, d).withColumn(
        "text",
        F.concat(
            F.lit("---\nauthority: 'ANVISA'\n# nota\nstatus: "),
            F.when(F.col("doc_id") % 2 == 0, P.STATUS_IN_FORCE).otherwise("vigente"),
            F.lit("\nautor: x\nauthority: \"CFF\"\ndocument_version: v"),
            F.col("doc_id").cast("string"),
            F.lit("\n---\n"),
            F.col("text"),
        ),
    )
    split = prepare.frontmatter_split(docs)
    return split.select(
        "doc_id",
        F.col("frontmatter")["authority"].alias("authority"),
        F.col("frontmatter")["status"].alias("status"),
        F.col("frontmatter")["document_version"].alias("document_version"),
        F.size("frontmatter").alias("fields"),
        T.sha_hex(F.col("body")).alias("body_hash"),
    )


@query
def sanitize_text(spark, d):
    out = prepare.sanitize_text(w.raw_pages(spark, d))
    return out.select("doc_id", "page", "clean_text", "removed_sentences")


def _meta(spark, d, *columns):
    return ing.derived(spark, d).select("tenant_id", "document_id", *columns)


@query
def extract_authority(spark, d):
    return _meta(spark, d, "authority")


@query
def extract_regulation_number(spark, d):
    return _meta(spark, d, "regulation_number")


@query
def extract_dates(spark, d):
    return _meta(spark, d, "publication_date")


@query
def extract_effective_date(spark, d):
    return _meta(spark, d, "effective_date")


@query
def extract_title_url_version(spark, d):
    return _meta(spark, d, "document_title", "source_url", "document_version")


META = (
    "tenant_id", "document_id", "filename", "authority", "regulation_number", "publication_date",
    "effective_date", "status", "document_title", "source_url", "document_version",
)


@query
def document_metadata(spark, d):
    return ing.derived(spark, d).select(*META)


@query
def confirmed_overlay(spark, d):
    return ing.metadata(spark, d).select(*META)


@query
def tokenize_corpus(spark, d):
    docs = T.with_tokens(w.table(spark, d, "documents").select("doc_id", "text"), "text")
    return docs.select(
        "doc_id",
        F.size("tokens").alias("terms"),
        F.array_join(F.sort_array("tokens"), " ").alias("sorted_terms"),
    )


@query
def reference_tokens(spark, d):
    pages = T.with_reference_tokens(w.raw_pages(spark, d), "text")
    return pages.select("doc_id", "page", F.array_join(F.sort_array("refs"), " ").alias("refs"))


@query
def estimate_tokens(spark, d):
    return w.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


# ------------------------------------------------------------------ structure


def _classified(spark, d):
    return chunking.classify_lines(chunking.page_lines(w.corpus_pages(spark, d)))


def _blocks(spark, d):
    return chunking.segment_blocks(chunking.carry_context(_classified(spark, d)))


@query
def classify_lines(spark, d):
    return _classified(spark, d).select(*KEY, "line_no", "kind", "label")


@query
def carry_context(spark, d):
    return chunking.carry_context(_classified(spark, d)).select(*KEY, "line_no", *chunking.FIELDS)


@query
def segment_blocks(spark, d):
    return _blocks(spark, d).select(*KEY, "block_no", "block", *[F.col(f"context.{f}") for f in chunking.FIELDS])


@query
def split_oversized(spark, d):
    return chunking.split_oversized(_blocks(spark, d)).select(*KEY, "block_no", "piece_no", "piece")


@query
def assemble_chunks(spark, d):
    chunks = chunking.assemble_chunks(chunking.split_oversized(_blocks(spark, d)))
    return chunks.select(*KEY, "body", *chunking.FIELDS)


@query
def item_label(spark, d):
    chunks = chunking.chunk_pages(w.corpus_pages(spark, d))
    return chunks.select("chunk_id", chunking.item_label().alias("label"))


@query
def number_chunks(spark, d):
    return chunking.chunk_pages(w.corpus_pages(spark, d)).select("chunk_id", *KEY, "chunk")


@query
def chunk_headers(spark, d):
    return ing.indexed_chunks(spark, d).drop("body")


@query
def chunk_stats(spark, d):
    return chunking.chunk_stats(chunking.chunk_pages(w.corpus_pages(spark, d)))

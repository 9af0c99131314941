"""Structural chunking as a dataflow: lines, carried context, blocks, pieces, chunks.

One shuffle by document serves the whole chain: every window and group below
is keyed by the document or by a page of it, so no further exchange is planned.
A document is one uploaded file; copies of it are collapsed before this point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T
from corpusloom.operators.prepare import DOC

PAGE = [*DOC, "page"]
FIELDS = ("title", "annex", "chapter", "section", "article", "paragraph", "inciso", "alinea")

# kind, pattern, captured group, level of the field it sets
MARKERS = (
    ("heading1", P.HEADING, 2, 0),
    ("heading2", P.HEADING, 2, 2),
    ("heading3", P.HEADING, 2, 3),
    ("annex", P.ANNEX, 1, 1),
    ("title_block", P.TITLE_BLOCK, 1, 2),
    ("chapter", P.CHAPTER, 1, 2),
    ("section", P.SECTION, 1, 3),
    ("article", P.ARTICLE, 1, 4),
    ("paragraph", P.PARAGRAPH, 1, 5),
    ("inciso", P.INCISO, 1, 6),
    ("alinea", P.ALINEA, 1, 7),
)
BOUNDARY_LEVEL = 4


def page_lines(pages: DataFrame) -> DataFrame:
    """One row per normalized line, already placed by document."""
    placed = pages.select(*PAGE, "text").repartition(*DOC)
    norm = placed.withColumn("_norm", T.normalize_lines(F.col("text")))
    return norm.select(*PAGE, F.posexplode(F.split("_norm", "\n", -1)).alias("line_no", "line"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Marker kind, its level and its label; the first matching marker wins."""
    line = F.col("line")
    hashes = F.length(F.regexp_extract(line, P.HEADING, 1))
    kind = (
        F.when(
            line.rlike(P.HEADING),
            F.when(hashes == 1, "heading1").when(hashes == 2, "heading2").otherwise("heading3"),
        )
        .when(line.rlike(P.ANNEX), "annex")
        .when(line.rlike(P.TITLE_BLOCK), "title_block")
        .when(line.rlike(P.CHAPTER), "chapter")
        .when(line.rlike(P.SECTION), "section")
        .when(line.rlike(P.ARTICLE), "article")
        .when(line.rlike(P.PARAGRAPH), "paragraph")
        .when(line.rlike(P.INCISO), "inciso")
        .when(line.rlike(P.ALINEA), "alinea")
        .otherwise("none")
    )
    label = F.lit(None).cast("string")
    level = F.lit(None).cast("int")
    for name, pattern, group, depth in MARKERS:
        text = T.strip(F.regexp_extract(line, pattern, group))
        if name == "article":
            text = F.rtrim(T.squeeze(text), F.lit("."))
        elif name == "paragraph":
            text = T.squeeze(text)
        elif name in ("inciso", "alinea"):
            text = F.concat(F.lit(name + " "), text)
        label = F.when(F.col("kind") == name, text).otherwise(label)
        level = F.when(F.col("kind") == name, F.lit(depth)).otherwise(level)
    return (
        lines.withColumn("kind", kind)
        .withColumn("level", level)
        .withColumn("label", label)
        .withColumn("is_boundary", F.coalesce(F.col("level") <= BOUNDARY_LEVEL, F.lit(False)))
    )


def carry_context(classified: DataFrame) -> DataFrame:
    """Running hierarchy of each page.

    A marker sets the field of its own level and clears every deeper one, so
    each field is the last non-null of: label, '' (cleared) or null (kept).
    """
    w = (
        Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    out = classified
    carried = {}
    for depth, field in enumerate(FIELDS):
        mark = F.when(F.col("level") == depth, F.col("label")).when(F.col("level") < depth, F.lit(""))
        carried[field] = F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit(""))
    starts = (F.col("is_boundary") & (F.col("line_no") > 0)).cast("int")
    return out.withColumns({**carried, "block_no": F.sum(starts).over(w).cast("int")})


def segment_blocks(carried: DataFrame) -> DataFrame:
    """Lines between boundaries, with the context of the first one."""
    lines = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    context = F.struct(*FIELDS)
    return (
        carried.groupBy(*PAGE, "block_no")
        .agg(
            F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"),
            F.min_by(context, F.col("line_no")).alias("context"),
        )
        .withColumn("block", F.rtrim("block", F.lit("\n")))
    )


def _units(block: Column, size: int, overlap: int) -> Column:
    """Paragraphs; sentences where a paragraph is too long; hard cuts where a sentence is."""
    step = max(1, size - overlap)

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(s) - 1, F.lit(step))
        windows = F.transform(starts, lambda i: T.strip(F.substring(s, i + 1, F.lit(size))))
        return F.when(F.length(s) <= size, F.array(s)).otherwise(windows)

    def sentences(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, P.SENTENCE_END, -1), T.strip), lambda s: s != "")
        return F.when(F.length(p) <= size, F.array(p)).otherwise(
            F.flatten(F.transform(parts, cut))
        )

    paragraphs = F.filter(F.transform(F.split(block, "\n\n", -1), T.strip), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paragraphs, sentences)), lambda u: u != "")


def _packed(units: Column, size: int, overlap: int) -> Column:
    """Greedy packing; a new piece opens with the tail of the one before."""
    empty = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, unit: Column) -> Column:
        glued = F.concat(acc["open"], F.lit("\n\n"), unit)
        tail = F.right(acc["open"], F.lit(overlap)) if overlap else F.lit("")
        reopened = F.when(
            (tail != "") & ~tail.rlike(P.ARTICLE_ONLY),
            T.strip(F.concat(tail, F.lit("\n\n"), unit)),
        ).otherwise(unit)
        fresh = F.struct(unit.alias("open"), acc["done"].alias("done"))
        longer = F.struct(glued.alias("open"), acc["done"].alias("done"))
        closed = F.struct(
            reopened.alias("open"), F.concat(acc["done"], F.array(acc["open"])).alias("done")
        )
        return (
            F.when(acc["open"] == "", fresh)
            .when(F.length(glued) <= size, longer)
            .otherwise(closed)
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )

    return F.aggregate(units, empty, step, finish)


def split_oversized(blocks: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per piece; a block within the limit is its own piece."""
    size, overlap = options.chunk_chars, options.overlap_chars
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and chunk size - 1")
    block = F.col("block")
    pieces = F.when(F.length(block) <= size, F.array(block)).otherwise(
        _packed(_units(block, size, overlap), size, overlap)
    )
    return blocks.select(
        *PAGE, "block_no", "context", F.posexplode(pieces).alias("piece_no", "piece")
    )


def assemble_chunks(pieces: DataFrame) -> DataFrame:
    """Join a bare article heading to the piece after it; a bare one at the end goes.

    Pieces never merge otherwise: every block after the first opens at a
    boundary, and the pieces of one block were split because they do not fit
    together. In a run of bare headings the odd ones open and the even ones close.
    """
    w = Window.partitionBy(*PAGE).orderBy("block_no", "piece_no")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("_bare", F.col("piece").rlike(P.ARTICLE_ONLY)).withColumn(
        "_pos", F.row_number().over(w)
    )
    last_full = F.coalesce(F.last(F.when(~F.col("_bare"), F.col("_pos")), True).over(run), F.lit(0))
    opened = placed.withColumn("_opens", F.col("_bare") & ((F.col("_pos") - last_full) % 2 == 1))
    linked = opened.withColumns(
        {
            "_joined": F.coalesce(F.lag("_opens").over(w), F.lit(False)),
            "_next": F.lead("piece").over(w),
        }
    )
    body = F.when(F.col("_opens"), F.concat("piece", F.lit("\n"), "_next")).otherwise(F.col("piece"))
    return (
        linked.filter(~F.col("_joined"))
        .withColumn("body", body)
        .filter("body <> ''")
        .select(*PAGE, "block_no", "piece_no", "body", *[F.col(f"context.{f}") for f in FIELDS])
    )


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Document-wide number from 1 and the chunk id."""
    w = Window.partitionBy(*DOC).orderBy("page", "block_no", "piece_no")
    return (
        chunks.withColumn("chunk", F.row_number().over(w))
        .withColumn("chunk_id", F.concat_ws(":", "tenant_id", "document_id", F.col("chunk").cast("string")))
        .drop("block_no", "piece_no")
    )


def item_label() -> Column:
    return F.nullif(
        F.concat_ws(", ", "article", "paragraph", "inciso", "alinea"), F.lit("")
    )


def chunk_pages(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Pages to numbered structural chunks."""
    carried = carry_context(classify_lines(page_lines(pages)))
    return number_chunks(assemble_chunks(split_oversized(segment_blocks(carried), options)))


def chunk_headers(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Indexed chunks: header of eight lines, blank line, body; typed metadata columns.

    Both sides are already placed by document, so the join adds no exchange.
    """
    joined = chunks.join(meta.drop("head_text"), DOC)
    unknown = F.lit(P.UNKNOWN)
    # The labels of the header lines.
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Documento: "), F.coalesce("document_title", "filename")),
        F.concat(F.lit("Orgao: "), F.coalesce("authority", unknown)),
        F.concat(F.lit("Norma: "), F.coalesce("regulation_number", unknown)),
        F.concat(F.lit("Capitulo: "), F.coalesce("chapter", "annex", unknown)),
        F.concat(F.lit("Secao: "), F.coalesce("section", unknown)),
        F.concat(F.lit("Artigo ou item: "), F.coalesce(item_label(), unknown)),
        F.concat(F.lit("Pagina: "), F.col("page").cast("string")),
        F.concat(F.lit("Status informado: "), T.status_label(F.col("status"))),
    )
    return joined.select(
        "chunk_id",
        *DOC,
        "filename",
        "page",
        "chunk",
        "body",
        F.concat(header, F.lit("\n\n"), F.col("body")).alias("text"),
        "authority",
        "regulation_number",
        "publication_date",
        "effective_date",
        "status",
        item_label().alias("article"),
        F.coalesce("section", "chapter").alias("section"),
        "source_url",
        "document_version",
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(*DOC).agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(F.length("body")), 6).alias("mean_length"),
        F.max(F.length("body")).alias("max_length"),
    )

"""Document preparation: identity, cleaning, front-matter, regulatory metadata.

Every step is a column expression over one document row; only the head of a
document (its first pages) needs grouping, on the document key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.functions import patterns as P
from corpusloom.functions import text as T

DOC = ["tenant_id", "document_id"]
META_FIELDS = (
    "authority", "regulation_number", "publication_date", "effective_date",
    "document_title", "source_url", "document_version",
)


def content_identity(df: DataFrame, content: str = "text") -> DataFrame:
    """``content_hash`` of the raw bytes and the short ``document_id``."""
    return df.withColumn("content_hash", T.sha_hex(F.col(content))).withColumn(
        "document_id", F.left(F.col("content_hash"), F.lit(24))
    )


def exact_duplicate_docs(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row per content and tenant: the earliest.

    ``row_number() = 1`` is cut to one row per key and task before the shuffle,
    so a content that fills a third of the table never meets in one place.
    """
    w = Window.partitionBy("tenant_id", "content_hash").orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def page_text_gate(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    return pages.filter(F.length("text") >= options.min_chars_per_page)


def extraction_quality(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Per document: pages, usable pages, characters, ratio and a verdict."""
    usable = F.length("text") >= options.min_chars_per_page
    grouped = pages.groupBy(*DOC).agg(
        F.count("*").alias("total_pages"),
        F.count_if(usable).alias("pages_with_text"),
        F.sum(F.length("text")).alias("total_chars"),
    )
    ratio = F.col("pages_with_text") / F.col("total_pages")
    return grouped.withColumn("extraction_ratio", F.round(ratio, 6)).withColumn(
        "verdict",
        F.when(F.col("pages_with_text") == 0, "empty")
        .when(ratio < options.min_extraction_ratio, "needs_ocr")
        .otherwise("ok"),
    )


def sanitize_text(df: DataFrame, source: str = "text") -> DataFrame:
    """Adds ``clean_text`` and ``removed_sentences``."""
    return T.with_sanitized(df, source, "clean_text", "removed_sentences")


def flag_injection(df: DataFrame, source: str = "text") -> DataFrame:
    return df.withColumn("flagged", T.has_injection(F.col(source)))


# --------------------------------------------------------------------------- front-matter


def frontmatter_split(df: DataFrame, source: str = "text") -> DataFrame:
    """Leading ``---`` block as an allow-listed map, and the text after it."""
    raw = F.regexp_replace(F.col(source), r"\A\ufeff", "")
    block = F.regexp_extract(raw, P.FRONTMATTER_BLOCK, 1)
    lines = F.filter(
        F.transform(F.split(block, r"\R", -1), T.strip),
        lambda s: (s != "") & ~s.startswith("#") & s.rlike(P.FRONTMATTER_LINE),
    )
    entries = F.transform(
        lines,
        lambda s: F.struct(
            F.regexp_extract(s, P.FRONTMATTER_LINE, 1).alias("key"),
            F.regexp_replace(
                T.strip(F.regexp_extract(s, P.FRONTMATTER_LINE, 2)), r"""\A["']+|["']+\z""", ""
            ).alias("value"),
        ),
    )
    valid = F.filter(
        entries,
        lambda e: e["key"].isin(*P.FRONTMATTER_KEYS)
        & (e["value"] != "")
        & ((e["key"] != "status") | e["value"].isin(*P.STATUS_LABELS)),
    )
    parsed = F.map_from_entries(valid)
    return (
        df.withColumn("frontmatter", parsed)
        .withColumn(
            "body",
            F.when(F.size("frontmatter") > 0, F.regexp_replace(raw, P.FRONTMATTER_BLOCK, "")).otherwise(raw),
        )
    )


def drop_empty_metadata(df: DataFrame, source: str = "metadata") -> DataFrame:
    """Map without null or empty values."""
    return df.withColumn(
        source, F.map_filter(F.col(source), lambda k, v: v.isNotNull() & (v != ""))
    )


# --------------------------------------------------------------------------- field extraction


def found(c: Column, pattern: str, likely: Column | None = None, group: int = 0) -> Column:
    """First match of a pattern, '' when it does not occur; only texts that are ``likely`` to match are searched.

    Searching a document happens once; the groups are then read off the match.
    """
    match = F.regexp_extract(c, pattern, group)
    return match if likely is None else F.when(likely | c.isNull(), match).otherwise(F.lit(""))


def authority(head: Column, caseless: Column | None = None) -> Column:
    """The first issuer whose pattern fits; ``caseless`` is ``T.caseless`` of the head, if it is at hand."""
    folded = T.caseless(head) if caseless is None else caseless
    picked = F.lit(None).cast("string")
    for label, pattern in reversed(P.AUTHORITIES):
        fits = T.mentions(folded, P.AUTHORITY_WORDS[label]) & head.rlike(pattern)
        picked = F.when(fits, F.lit(label)).otherwise(picked)
    return picked


def regulation_number(match: Column) -> Column:
    """Canonical ``TYPE number[/year]``; two-digit years above 50 belong to the 1900s."""
    kind = T.squeeze(F.regexp_extract(match, P.REGULATION, 1))
    table = F.create_map(*[F.lit(x) for pair in P.REGULATION_TYPES.items() for x in pair])
    canonical = F.coalesce(F.try_element_at(table, T.strip_accents(F.lower(kind))), F.upper(kind))
    number = F.regexp_extract(match, P.REGULATION, 2)
    year = F.regexp_extract(F.regexp_extract(match, P.REGULATION, 3), r"(\d{2,4})\s*$", 1)
    full = (
        F.when((F.length(year) == 2) & (year.try_cast("int") > 50), F.concat(F.lit("19"), year))
        .when(F.length(year) == 2, F.concat(F.lit("20"), year))
        .otherwise(year)
    )
    name = F.concat(canonical, F.lit(" "), number)
    return F.when(
        match != "", F.when(year == "", name).otherwise(F.concat(name, F.lit("/"), full))
    )


def iso_date(long_match: Column, short_match: Column) -> Column:
    """A long date, else a short one, as ISO text; no calendar check."""
    months = F.create_map(*[F.lit(x) for pair in P.MONTHS.items() for x in pair])

    def iso(match: Column, pattern: str, month: Column) -> Column:
        part = lambda g: F.regexp_extract(match, pattern, g).try_cast("int")
        return F.when(month > 0, F.format_string("%04d-%02d-%02d", part(3), month, part(1)))

    named = F.try_element_at(months, F.lower(F.regexp_extract(long_match, P.DATE_LONG, 2)))
    numeric = F.regexp_extract(short_match, P.DATE_SHORT, 2).try_cast("int")
    return F.when(long_match != "", iso(long_match, P.DATE_LONG, named)).when(
        short_match != "", iso(short_match, P.DATE_SHORT, numeric)
    )


def document_title(head: Column) -> Column:
    bare = F.transform(
        F.split(head, "\n", -1),
        lambda s: T.strip(F.ltrim(T.strip(s), F.lit("# "))),
    )
    first = F.try_element_at(F.filter(bare, lambda s: F.length(s) >= 12), F.lit(1))
    return F.left(first, F.lit(200))


def document_heads(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Text of the first usable pages of each document, joined by a line break."""
    w = Window.partitionBy(*DOC).orderBy("page")
    first = (
        page_text_gate(pages, options)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= options.graph_pages)
    )
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    return first.groupBy(*DOC).agg(
        F.first("filename").alias("filename"),
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("head_text"),
    )


def derive_metadata(heads: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Fields read off the sanitized head; what is not found stays null."""
    top, folded = F.col("_top"), F.col("_folded")
    staged = (
        T.with_sanitized(heads, "head_text", "_clean")
        .withColumn("_top", F.left("_clean", F.lit(options.head_chars)))
        .withColumn("_folded", T.caseless(top))
        .withColumns(
            {
                "_norm": found(top, P.REGULATION),
                "_long": found(top, P.DATE_LONG),
                "_short": found(top, P.DATE_SHORT, T.mentions(top, P.DATE_SHORT_WORDS)),
                "_force": found(F.col("_clean"), P.EFFECTIVE, T.mentions(T.caseless(F.col("_clean")), P.EFFECTIVE_WORDS)),
                "_url": found(top, P.URL, T.mentions(top, P.URL_WORDS)),
                "_version": found(top, P.VERSION, T.mentions(folded, P.VERSION_WORDS), 1),
                "_title": document_title(top),
                "_authority": authority(top, folded),
            }
        )
    )
    force = F.col("_force")
    return staged.select(
        *DOC,
        "filename",
        "head_text",
        F.col("_authority").alias("authority"),
        regulation_number(F.col("_norm")).alias("regulation_number"),
        iso_date(F.col("_long"), F.col("_short")).alias("publication_date"),
        iso_date(found(force, P.DATE_LONG), found(force, P.DATE_SHORT)).alias("effective_date"),
        F.lit(P.STATUS_UNVERIFIED).alias("status"),
        F.col("_title").alias("document_title"),
        F.nullif("_url", F.lit("")).alias("source_url"),
        F.nullif("_version", F.lit("")).alias("document_version"),
    )


def confirmed_overlay(meta: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed values win over derived ones; a status only from the valid set.

    ``confirmed`` has one row per (tenant, filename) with nullable text fields.
    """
    names = [c for c in (*META_FIELDS, "status") if c in confirmed.columns]
    side = confirmed.select(
        "tenant_id", "filename", *[T.strip(F.col(c)).alias(f"_c_{c}") for c in names]
    )
    joined = meta.join(side, ["tenant_id", "filename"], "left")
    for c in names:
        given = F.col(f"_c_{c}")
        accepted = given.isin(*P.STATUS_LABELS) if c == "status" else given != ""
        joined = joined.withColumn(c, F.when(accepted, given).otherwise(F.col(c)))
    return joined.drop(*[f"_c_{c}" for c in names])


def merge_confirmed(frontmatter: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One confirmed row per file; the sidecar wins key by key."""
    names = [c for c in (*META_FIELDS, "status")]
    left, right = frontmatter.alias("f"), sidecars.alias("s")
    joined = left.join(right, ["tenant_id", "filename"], "full_outer")
    return joined.select(
        "tenant_id",
        "filename",
        *[F.coalesce(F.col(f"s.{c}"), F.col(f"f.{c}")).alias(c) for c in names],
    )


def document_metadata(
    pages: DataFrame, confirmed: DataFrame | None = None, options: Options = DEFAULTS
) -> DataFrame:
    meta = derive_metadata(document_heads(pages, options))
    return meta if confirmed is None else confirmed_overlay(meta, confirmed)

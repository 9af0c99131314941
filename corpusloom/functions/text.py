"""Text expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P

_RANGES = ((0x80, 0x250), (0x370, 0x460), (0x1E00, 0x2000), (0x2000, 0x20A0), (0x3000, 0x3001), (0xFF10, 0xFF5B))


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _accent_table() -> tuple[str, str]:
    """Code points whose compatibility form without marks is one letter, digit or space."""
    pairs = [
        (chr(cp), _plain(chr(cp))) for start, stop in _RANGES for cp in range(start, stop)
    ]
    kept = [(a, b) for a, b in pairs if a != b and len(b) == 1 and (b.isalnum() or b == " ")]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENT_FROM, ACCENT_TO = _accent_table()
# Compatibility forms longer than one character.
EXPANSIONS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "№": "No", "™": "TM", "…": "...",
}
_BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


BLANKS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{_BLANKS}]+", " ")


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; plain ASCII passes untouched."""
    expanded = c
    for mark, letters in EXPANSIONS.items():
        expanded = F.replace(expanded, F.lit(mark), F.lit(letters))
    wide = F.when(c.rlike("[" + "".join(EXPANSIONS) + "]"), expanded).otherwise(c)
    bare = F.regexp_replace(F.translate(wide, ACCENT_FROM, ACCENT_TO), r"\p{M}+", "")
    return F.when(F.octet_length(c) > F.length(c), bare).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Accents off, case folded, white space collapsed."""
    folded = F.lower(strip_accents(c))
    folded = F.replace(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(squeeze(folded))


LINE_BLANKS = " \t\x0b\f" + "".join(b for b in BLANKS if b not in " \t\n\x0b\f\r")


def normalize_lines(c: Column) -> Column:
    """Unix line ends, no soft hyphens, trimmed lines, no runs of blanks or blank lines.

    Lines are trimmed one by one: most have nothing for a pattern to find.
    """
    text = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.replace(text, F.lit("\u00ad"), F.lit(""))
    trimmed = F.transform(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(LINE_BLANKS)))
    lines = F.transform(trimmed, lambda s: F.when(mentions(s, ("  ", "\t")), F.regexp_replace(s, r"[ \t]{2,}", " ")).otherwise(s))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit("\n"))


def mentions(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words lies in the text: a cheap search before a costly pattern."""
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def caseless(c: Column) -> Column:
    """Lower case, also of the letters that only a pattern without case takes for i and s."""
    folded = F.lower(c)
    for mark, letter in (("ı", "i"), ("\u0307", ""), ("ſ", "s")):
        folded = F.replace(folded, F.lit(mark), F.lit(letter))
    return folded


def _with_lowered(df: DataFrame, source: str) -> DataFrame:
    """Adds ``_low``, in two projections, so that a text is lowered once."""
    return df.withColumn("_case", F.lower(F.col(source))).withColumn("_low", strip_accents(F.col("_case"))).drop("_case")


def _number_year_terms(lowered: Column, bare_year: bool) -> Column:
    """``number/year`` with its short or long twin; optionally the expanded year alone."""
    found = F.when(mentions(lowered, ("/", "-")), F.regexp_extract_all(lowered, F.lit(P.NUMBER_YEAR), F.lit(0))).when(
        lowered.isNotNull(), F.array().cast("array<string>")
    )

    def variants(m: Column) -> Column:
        number = F.replace(F.regexp_extract(m, P.NUMBER_YEAR, 1), F.lit("."), F.lit(""))
        year = F.regexp_extract(m, P.NUMBER_YEAR, 2)
        century = F.when(year.cast("int") > 50, F.lit("19")).otherwise(F.lit("20"))
        long_year = F.concat(century, year)
        slash = F.lit("/")
        base = F.concat(number, slash, year)
        twins = [base, F.concat(number, slash, long_year)] + ([long_year] if bare_year else [])
        return (
            F.when(F.length(year) == 2, F.array(*twins))
            .when(F.length(year) == 4, F.array(base, F.concat(number, slash, F.right(year, F.lit(2)))))
            .otherwise(F.array(base))
        )

    return F.flatten(F.transform(found, variants))


def _article_terms(lowered: Column) -> Column:
    found = F.regexp_extract_all(lowered, F.lit(P.ARTICLE_REF), F.lit(0))
    return F.transform(
        found,
        lambda m: F.concat(
            F.lit("art"), F.regexp_extract(m, P.ARTICLE_REF, 1), F.regexp_extract(m, P.ARTICLE_REF, 2)
        ),
    )


def with_tokens(df: DataFrame, source: str, target: str = "tokens") -> DataFrame:
    """Lexical terms with repeats: words without stopwords, norm numbers, article marks.

    The folded text is its own projection so that it is computed once per row.
    """
    low = F.col("_low")
    words = F.filter(
        F.regexp_extract_all(low, F.lit(P.WORD), F.lit(1)), lambda w: ~w.isin(*P.STOPWORDS)
    )
    terms = F.concat(words, _number_year_terms(low, True), _article_terms(low))
    return _with_lowered(df, source).withColumn(target, terms).drop("_low")


def with_has_terms(df: DataFrame, source: str, target: str) -> DataFrame:
    """Whether a text has lexical terms; the search ends at the first of them.

    An article mark starts with a word that is no stopword, a norm number may be written in other digits.
    """
    low = F.col("_low")
    word = rf"(?<![a-z0-9])(?!(?:{'|'.join(P.STOPWORDS)})(?![a-z0-9]))[a-z0-9]"
    return _with_lowered(df, source).withColumn(target, low.rlike(word) | low.rlike(P.NUMBER_YEAR)).drop("_low")


def with_reference_tokens(df: DataFrame, source: str, target: str = "refs") -> DataFrame:
    """Distinct terms that name a norm or an article."""
    low = F.col("_low")
    terms = F.array_distinct(F.concat(_number_year_terms(low, False), _article_terms(low)))
    return _with_lowered(df, source).withColumn(target, terms).drop("_low")


def estimate_tokens(c: Column, chars_per_token: float = 3.3) -> Column:
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / F.lit(chars_per_token)).cast("int")


def has_injection(c: Column) -> Column:
    return F.lower(c).rlike(P.INJECTION)


def with_sanitized(df: DataFrame, source: str, target: str, removed: str | None = None) -> DataFrame:
    """Text without sentences that give orders to the assistant, and how many went.

    Most texts are clean: they hold none of the words that every such sentence has, and are never split.
    """
    text = F.col(source)
    sentences = F.split(text, P.SENTENCE_CUT, -1)
    dropped = F.size("_all") - F.size("_kept")
    joined = strip(F.array_join("_kept", ""))
    marked = F.when(joined == "", F.lit(P.REDACTION_MARKER)).otherwise(
        F.concat(joined, F.lit("\n" + P.REDACTION_MARKER))
    )
    out = (
        df.withColumn("_lower", F.lower(text))
        .withColumn("_all", F.when(mentions(F.col("_lower"), P.INJECTION_WORDS) & F.col("_lower").rlike(P.INJECTION), sentences))
        .withColumn("_kept", F.filter("_all", lambda s: ~has_injection(s)))
        .withColumn(
            target,
            F.when(F.col("_all").isNull(), text).when(dropped > 0, marked).otherwise(joined),
        )
    )
    if removed:
        out = out.withColumn(removed, F.when(F.col("_all").isNull(), 0).otherwise(dropped))
    return out.drop("_lower", "_all", "_kept")


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two distinct-term arrays; 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / union)


def sha_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def status_label(c: Column) -> Column:
    """Display label; an unknown or missing status reads as not verified."""
    label = F.lit(P.STATUS_LABELS[P.STATUS_UNVERIFIED])
    for status, text in P.STATUS_LABELS.items():
        label = F.when(c == status, F.lit(text)).otherwise(label)
    return label

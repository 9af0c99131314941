"""URL filter by association rules between URL tokens and labels.

A URL becomes a set of tokens: its host, the words of the host, path segments, file
extension, query keys and a mark for a fragment; tokens of digits alone are one token. Token combinations that are
frequent among labelled URLs are counted with the label, a size at a time, each size by one grouping of all labelled URLs.
A combination whose share of one label reaches ``CONFIDENCE`` is a rule; a rule falls away
if a part of it is a rule for the same label and as sure. Rules are kept under their rarest token, so
a URL looks up only the rules of its own tokens and checks the rest of each. Of the rules that fit, the surest
decides, then the most frequent, then the longer one, then block before allow. A URL that no rule fits is allowed.

Bounds: a rule has at most ``RULE_TOKENS`` tokens and is right in ``SUPPORT`` of the labelled URLs, ``LEAST_ROWS`` at least; that is what a rule
is. Every token takes part, and all tokens of a URL. A combination is not extended where no larger rule could stay beside its parts: if all its
URLs have one label, and if a part of it lies in the same URLs (so the fixed tokens of a template do not multiply). Since combinations
are frequent, their number depends on the tokens of a URL, not on the input; rules travel to the tasks with the function.
All labelled URLs are counted and mined. Judging reads each URL once and shuffles nothing.

Edge cases: a null URL, or one without ``://``, has an empty host and path and no token; it is allowed unless
a stated rule says otherwise. Repeated rows are judged alike and count as often as they come. URLs of any length are taken
whole. Without labelled URLs, or with one label only for every token, there may be no rule: all is allowed. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.session import written

SUPPORT, CONFIDENCE = 0.005, 0.95
#: Labelled URLs that a frequent combination takes at least.
LEAST_ROWS = 20
RULE_TOKENS = 4

ALLOW, BLOCK = "allow", "block"
#: Items that stand for labels; no URL token begins so.
LABEL = {ALLOW: "=allow", BLOCK: "=block"}

# --------------------------------------------------------------------------- stated rules


@dataclass(frozen=True)
class Stated:
    """A verdict for a host with its subdomains, where the path begins as given."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: str = "url") -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path of a URL; both empty without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))

    return F.translate(part(1), UPPER, LOWER), part(2)


def stated_verdicts(addresses: DataFrame, rules: list[Stated]) -> DataFrame:
    """Adds ``rule`` and ``stated``: name and verdict of the longest stated rule that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return addresses.withColumns({"rule": rule, "stated": verdict})


# --------------------------------------------------------------------------- tokens


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL that has ``host`` and ``path`` columns, each marked by where it stands."""

    def marked(mark: str, words: Column) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)))

    labels = F.split("host", r"\.")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.concat(
        marked("host:", F.array(F.col("host"))),
        marked("word:", F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]")))),
        marked("path:", F.split(F.lower(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")), "[/_.~-]+")),
        marked("end:", F.array(ending)),
        marked("query:", F.transform(F.split(query, "[&;]"), lambda p: F.substring_index(p, "=", 1))),
        F.array(F.when(F.contains(F.col(url), F.lit("#")), "fragment:").otherwise(":")),
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(parts, lambda t: ~F.endswith(t, F.lit(":")) | (t == "fragment:")))
    )


# --------------------------------------------------------------------------- mining


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


#: Combinations that a task counts before it passes its sums on.
COUNTED = 100_000


def extensions(items: list[str], open_: set[tuple[str, ...]], size: int) -> Iterator[tuple[str, ...]]:
    """Combinations of ``size`` sorted items whose parts one smaller are all open."""
    front: list[tuple[str, ...]] = [()]
    for length in range(1, size + 1):
        grown = ((*f, item) for f in front for item in items if not f or item > f[-1])
        if length == size:
            yield from (c for c in grown if size == 1 or all(p in open_ for p in combinations(c, size - 1)))
        else:
            front = [c for c in grown if c in open_]


def counted(baskets: DataFrame, open_: set[tuple[str, ...]], size: int, least: float) -> list[Row]:
    """tokens, n and b (rows in all, blocked ones) of every extension of ``open_`` in ``least`` rows or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, ...], list[int]] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame(
                {"tokens": [list(t) for t in sums], "n": [v[0] for v in sums.values()], "b": [v[1] for v in sums.values()]}
            )
            sums.clear()
            return made

        for frame in frames:
            for items, n, b in zip(frame["tokens"], frame["n"], frame["b"], strict=True):
                known = sorted(t for t in items if size == 1 or (t,) in open_)
                for combination in extensions(known, open_, size):
                    have = sums.setdefault(combination, [0, 0])
                    have[0] += n
                    have[1] += b
                    if len(sums) > COUNTED:
                        yield out()
        if sums:
            yield out()

    found = baskets.mapInPandas(run, "tokens array<string>, n long, b long")
    return found.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.col("n") >= least).collect()


def mine(labelled: DataFrame) -> list[Rule]:
    """Rules from (tokens, label), surest first."""
    blocked = F.count_if(F.col("label") == BLOCK)
    baskets = written(
        labelled.groupBy(F.sort_array(F.array_distinct("tokens")).alias("tokens")).agg(F.count("*").alias("n"), blocked.alias("b"))
    )
    n = baskets.agg(F.sum("n")).first()[0] or 0
    least = max(SUPPORT * n, LEAST_ROWS)
    rows: dict[tuple[str, ...], int] = {(): n}
    sure: dict[tuple[tuple[str, ...], str], Rule] = {}
    open_: set[tuple[str, ...]] = set()
    for size in range(1, RULE_TOKENS + 1):
        if n < least or (size > 1 and not open_):
            break
        for row in counted(baskets, set(open_), size, least):
            tokens, seen = tuple(row["tokens"]), {BLOCK: row["b"], ALLOW: row["n"] - row["b"]}
            rows[tokens] = row["n"]
            if size > 1 and any(rows[p] == row["n"] for p in combinations(tokens, size - 1)):
                continue
            for verdict, k in seen.items():
                if k >= least and k / row["n"] >= CONFIDENCE:
                    sure[tokens, verdict] = Rule(tokens, verdict, k / row["n"], k / n)
            if row["n"] < n and max(seen.values()) < row["n"]:
                open_.add(tokens)
    kept = [r for r in sure.values() if not any(p.confidence >= r.confidence for p in parts_of(r, sure))]
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, -len(r.tokens), r.verdict != BLOCK, r.tokens))


def parts_of(rule: Rule, sure: dict[tuple[tuple[str, ...], str], Rule]) -> Iterator[Rule]:
    """The rules for the same verdict that proper parts of the rule make."""
    for size in range(1, len(rule.tokens)):
        for part in combinations(rule.tokens, size):
            if (part, rule.verdict) in sure:
                yield sure[part, rule.verdict]


# --------------------------------------------------------------------------- matching


def inverted(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[tuple[int, frozenset[str], str]]]:
    """Rules by their rarest token, as (rank, tokens, verdict)."""
    index: dict[str, list[tuple[int, frozenset[str], str]]] = {}
    for rank, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(rarest, []).append((rank, frozenset(rule.tokens), rule.verdict))
    return index


def best_rule(index: dict[str, list[tuple[int, frozenset[str], str]]], have: set[str]) -> tuple[int, str] | None:
    """Rank and verdict of the first rule whose tokens are all there."""
    best = None
    for token in have:
        for rank, needed, verdict in index.get(token, ()):
            if best is not None and rank > best[0]:
                break
            if needed <= have:
                best = (rank, verdict)
                break
    return best


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``mined``, the verdict of the first rule that fits ``tokens`` (none: allow), and ``mined_rule``, its tokens."""
    counts: dict[str, int] = {}
    for rule in rules:
        for t in rule.tokens:
            counts[t] = counts.get(t, 0) + 1
    index = inverted(rules, counts)
    names = [" ".join(r.tokens) for r in rules]

    @F.pandas_udf("verdict string, rule string")
    def match(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            hits = [best_rule(index, set(have)) for have in column]
            yield pd.DataFrame(
                {"verdict": [h[1] if h else ALLOW for h in hits], "rule": [names[h[0]] if h else None for h in hits]}
            )

    return rows.withColumn("_m", match("tokens")).withColumns({"mined": F.col("_m.verdict"), "mined_rule": F.col("_m.rule")}).drop("_m")


def filtered(pages: DataFrame, stated: list[Stated]) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every URL.

    URLs that a stated rule decides are the labelled ones; what is mined from them decides the others.
    """
    host, path = address()
    rows = stated_verdicts(pages.select("page_id", "url", host.alias("host"), path.alias("path")), stated).withColumn("tokens", tokens())
    labelled = written(rows.where("stated IS NOT NULL").select("tokens", F.col("stated").alias("label")))
    out = judged(rows, mine(labelled))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("stated", "mined").alias("verdict"),
        F.when(F.col("stated").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )

"""Blocks of postings: build, pruning, skipping and placement, against the flat index."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.config import DEFAULTS, Options
from corpusloom.operators import blockmax, lexical, packed
from corpusloom.plans import retrieval
from corpusloom.session import written

TOKENS = "tenant_id string, document_id string, chunk_id string, tokens array<string>, doc_len int"


@pytest.fixture(scope="module")
def tokens(spark):
    """Two tenants, one with most chunks; a common term, rare ones, copies and one very long chunk."""
    rng, rows = random.Random(4), []
    for i in range(1500):
        tenant = "hot" if i % 5 else "t#2"
        words = ["comum"] + [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(1, 30))]
        words = ["comum", "copia"] if i % 7 == 0 else words * (200 if i == 11 else 1)
        rows.append((tenant, f"d{i // 3}", f"{tenant}:d{i // 3}:{i}", words, len(words)))
    return written(spark.createDataFrame(rows, TOKENS))


@pytest.fixture(scope="module")
def stored(tokens):
    return lexical.stored_index(tokens)


def asked(spark, *questions):
    rows = [(t, i, x) for i, q in enumerate(questions) for t in ("hot", "t#2", "nobody") for x in set(q.split())]
    return spark.createDataFrame(rows, "tenant_id string, query_id long, term string")


def best(index, terms):
    return sorted(map(tuple, lexical.top_n(lexical.bm25_scores(index, terms), "bm25_score", "bm25_rank", DEFAULTS.candidates)
                      .select("tenant_id", "query_id", "chunk_id", "document_id", "bm25_score", "bm25_rank").collect()))


QUESTIONS = ["w1 w2 w3", "comum", "copia comum", "w7 w399 ausente", "ausente", " ".join(f"w{i}" for i in range(40))]


def test_same_rows_as_the_flat_index(spark, tokens, stored):
    terms = asked(spark, *QUESTIONS)
    assert best(stored, terms) == best(lexical.inverted_index(tokens), terms)


def test_same_rows_in_many_parts(spark, tokens, stored, monkeypatch):
    monkeypatch.setattr(blockmax, "QUESTIONS", 3)
    terms = asked(spark, *(QUESTIONS * 4))
    assert best(stored, terms) == best(lexical.inverted_index(tokens), terms)


def test_blocks_hold_every_posting_and_bound_it(tokens, stored):
    flat = lexical.inverted_index(tokens)
    names = ["tenant_id", "document_id", "chunk_id", "doc_len", "term", "tf"]
    assert sorted(map(tuple, stored.postings.select(*names).collect())) == sorted(map(tuple, flat.postings.select(*names).collect()))
    assert sorted(map(tuple, stored.frequencies.collect())) == sorted(map(tuple, flat.frequencies.collect()))
    bad = stored.blocks.blocks.where(
        (F.size("postings") != F.col("size")) | F.exists("postings", lambda p: (p["tf"] > F.col("max_tf")) | (p["doc_len"] < F.col("min_len")))
        | F.exists("postings", lambda p: F.floor(p["ord"] / blockmax.SPAN) != F.col("span"))
    )
    assert bad.count() == 0


def test_spans_cut_by_batches_stay_whole():
    rows = pa.table({
        "shard": pa.array([0] * 150 + [3] * 10, pa.int32()), "ord": pa.array([*range(150), *range(10)], pa.int32()),
        "tenant_id": ["a"] * 70 + ["b"] * 90, "doc_len": pa.array([2] * 160, pa.int32()), "tokens": [["x", "x"] if i % 2 else ["x", "y"] for i in range(160)],
    })
    whole = blockmax.block_rows(rows).sort_by([("shard", "ascending"), ("span", "ascending"), ("tenant_id", "ascending"), ("term", "ascending")])
    for size in (1, 7, 64, 200):
        cut = pa.Table.from_batches(blockmax.blocks_of(iter(rows.to_batches(max_chunksize=size))))
        assert cut.sort_by([("shard", "ascending"), ("span", "ascending"), ("tenant_id", "ascending"), ("term", "ascending")]) == whole
    assert list(blockmax.blocks_of(iter([]))) == []


def block_of(postings):
    n = len(postings)
    return pa.table({
        "term": [p[0] for p in postings], "span": pa.array([p[1] for p in postings], pa.int32()),
        "max_tf": pa.array([max(t for _, t, _ in p[2]) for p in postings], pa.int32()),
        "min_len": pa.array([min(x for _, _, x in p[2]) for p in postings], pa.int32()),
        "postings": pa.array([[dict(zip(("ord", "tf", "doc_len"), x)) for x in p[2]] for p in postings],
                             pa.list_(pa.struct([("ord", pa.int32()), ("tf", pa.int32()), ("doc_len", pa.int32())]))),
        "shard": pa.array([5] * n, pa.int32()),
    })


def test_spans_below_the_floor_are_not_scored(monkeypatch):
    """One span holds the n best; the postings of the others are never weighed."""
    n = 3
    strong = [("a", 0, [(i, 9, 5) for i in range(4)])]
    weak = [("a", s, [(64 * s, 1, 50)]) for s in range(1, 40)]
    terms = pa.table({"term": ["a"], "qno": [7], "gain": [2.0], "flat": [0.4], "slope": [0.1], "shard": pa.array([5], pa.int32())})
    weighed = []
    real = np.round
    monkeypatch.setattr(blockmax.np, "round", lambda x, d: weighed.append(x.size) or real(x, d))
    got = blockmax.best_of_block(block_of(strong + weak), terms, n)
    assert got["ord"].to_pylist() == [0, 1, 2] and weighed == [4]


def test_best_of_block_equals_all_scores():
    rng = np.random.default_rng(1)
    for seed in range(20):
        n = 4
        blocks = [
            (t, s, [(int(o), int(rng.integers(1, 4)), int(10 + o % 7)) for o in sorted(rng.choice(64, rng.integers(1, 20), replace=False) + 64 * s)])
            for t in "abcde" for s in range(5) if rng.random() < 0.7
        ]
        terms = [(t, q, float(rng.integers(1, 5))) for q in range(6) for t in "abcdef" if rng.random() < 0.5]
        table = pa.table({"term": [t[0] for t in terms], "qno": pa.array([t[1] for t in terms], pa.int64()), "gain": [t[2] for t in terms],
                          "flat": [0.4] * len(terms), "slope": [0.1] * len(terms), "shard": pa.array([5] * len(terms), pa.int32())})
        scores = {}
        for t, q, g in terms:
            for bt, _, ps in blocks:
                for o, tf, ln in ps if bt == t else ():
                    scores[q, o] = scores.get((q, o), 0.0) + g * tf / (tf + 0.4 + 0.1 * ln)
        want = [
            (q, o, s) for q in range(6)
            for o, s in sorted(((o, round(s, 6)) for (k, o), s in scores.items() if k == q), key=lambda x: (-x[1], x[0]))[:n]
        ]
        got = blockmax.best_of_block(block_of(blocks), table, n)
        assert list(zip(got["qno"].to_pylist(), got["ord"].to_pylist(), got["score"].to_pylist())) == want


def hits(spark, stored, terms):
    full = terms.join(stored.frequencies, ["tenant_id", "term"]).join(stored.totals, "tenant_id")
    idf, flat, slope = lexical.term_parts(Options())
    full = written(full.select("tenant_id", "query_id", "term", idf.alias("gain"), F.lit(flat).alias("flat"), slope.alias("slope")))
    questions, parts = blockmax.question_blocks(full)
    return blockmax.shard_hits(stored.blocks, full, questions, parts, 12)


def test_blocks_stay_in_place_without_broadcasts(spark, stored):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        with blockmax.co_located_joins(spark):
            plan = hits(spark, stored, asked(spark, *QUESTIONS))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    start = next(i for i, x in enumerate(lines) if "FlatMapCoGroups" in x)
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "postings" in x)
    assert "SortMergeJoin" in plan and not any("Exchange" in x for x in lines[start:scan])
    assert "PartitionFilters: [term_bin" in plan.replace("isnotnull(term_bin), ", "")


def test_few_terms_open_few_folders(spark, stored):
    def files(*words):
        terms = spark.createDataFrame([("hot", x) for x in words], "tenant_id string, term string")
        blocks = blockmax.asked_blocks(stored.blocks, terms)
        return len({r[0] for r in blocks.select(F.input_file_name()).distinct().collect()}), blocks.count()

    one, three, many = files("w1"), files("w1", "w2", "w3"), files(*(f"w{i}" for i in range(400)))
    assert one[0] < many[0] / 8 and one[0] <= three[0] < many[0] and one[1] < three[1] < many[1]


def test_chunks_with_a_term(spark, tokens, stored):
    wanted = spark.createDataFrame([("hot", "w3"), ("hot", "copia"), ("t#2", "w399"), ("nobody", "w1")], "tenant_id string, term string")
    flat = lexical.contains_any_token(lexical.inverted_index(tokens), wanted)
    assert sorted(map(tuple, lexical.contains_any_token(stored, wanted).collect())) == sorted(map(tuple, flat.collect()))


def test_an_empty_index_answers_nothing(spark):
    index = lexical.stored_index(spark.createDataFrame([], TOKENS))
    assert best(index, asked(spark, "w1")) == []


@pytest.mark.parametrize("chunks, held, span", [(2048, 32_768, 64), (50, 120, 7), (1, 2, 1)])
def test_packed_search_finds_what_the_index_finds(spark, tokens, stored, monkeypatch, chunks, held, span):
    """Ties at the twelfth place included; questions without a known term and tenants without chunks give nothing."""
    monkeypatch.setattr(packed, "SPAN", span)
    monkeypatch.setattr(packed, "CHUNKS", chunks)
    rows = tokens.toArrow().select(TOKENS_ORDER)
    monkeypatch.setattr(packed, "HELD", held)
    batches = list(packed.packed_blocks(rows.to_batches(max_chunksize=97)))
    assert sum(len(b["chunks"][0]) for b in batches) == 1500 and max(len(b["chunks"][0]) for b in batches) <= chunks
    packs = written(spark.createDataFrame(pa.Table.from_batches(batches), packed.PACKED))
    terms = asked(spark, *QUESTIONS)
    assert best(lexical.Packs(packs), terms) == best(stored, terms) != []


TOKENS_ORDER = ["tenant_id", "document_id", "chunk_id", "tokens", "doc_len"]


def test_packing_and_its_search_move_no_chunks(spark, tokens):
    packs = lexical.stored_packs(tokens)
    assert best(packs, asked(spark, *QUESTIONS)) == best(lexical.inverted_index(tokens), asked(spark, *QUESTIONS))
    frequencies = {tuple(r) for r in lexical.document_frequency(lexical.bm25_postings(tokens)).collect()}
    terms = asked(spark, "comum w1 w399 ausente")
    found = {tuple(r) for r in packed.document_frequency(packs.packs, terms).collect()}
    assert found == {f for f in frequencies if f[1] in ("comum", "w1", "w399")}
    assert best(lexical.stored_packs(tokens.limit(0)), terms) == []


def test_a_search_by_words_stores_no_index(spark, sf):
    st = retrieval.Snapshot(spark, sf)
    assert isinstance(st.searched, lexical.Packs) and not st.has("index") and not st.has("chunks")

"""Near copies, vector search and archives."""

import base64
import hashlib
import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import impact_search, near_duplicates, warc
from corpusloom.llm.common import prepare


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_classes(rows):
    """Smallest doc_id of the component that all similar pairs make."""
    shingles = [near_duplicates.labelled(near_duplicates.words_of(t)).tolist() for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = shingles[i], shingles[j]
        same = near_duplicates.words_of(rows[i][1]) == near_duplicates.words_of(rows[j][1])
        if not same and set(a) & set(b):
            m = lcs(a, b)
            same = m / (len(a) + len(b) - m) >= 0.8 - 1e-12
        if same:
            parent[top(j)] = top(i)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(top(k), []).append((doc_id is None, doc_id or 0, doc_id))
    return [min(groups[top(k)])[2] for k in range(len(rows))]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for base in range(14):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 90, 130, 200]))]
        if base % 3 == 0:
            words = words[:30] + passage
        for _ in range(rng.randint(1, 5)):
            rows.append(" ".join(edited(rng, words, rng.choice([0, 1, 2, 3]))))
    rows += ["again and " * 60, "again and " * 55, "", None, " \n", "one two three", "one  two\nthree", "one two", rows[0].replace(" ", "\n")]
    rng.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)] + [(None, rows[0]), (3, rows[3])]


def test_classes_equal_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, row string, bucket int")
    got = sorted((str(r.doc_id), r.class_id) for r in near_duplicates.classes(docs).collect())
    want = sorted((str(d), c) for (d, _), c in zip(rows, brute_classes(rows), strict=True))
    assert got == want
    kept = near_duplicates.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(rows)))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.classes(empty).count() == 0
    assert near_duplicates.first_of_each(empty).count() == 0


def test_buckets_of_different_texts_lose_no_link(spark):
    """All texts share a bucket whose smallest node is like none of them."""
    rng = random.Random(2)
    texts = {0: "alone " + " ".join(f"z{k}" for k in range(30))}
    for group in range(30):
        words = [f"g{group}w{k}" for k in range(30)]
        for copy in range(2):
            texts[len(texts)] = " ".join(words if not copy else edited(rng, words[:28], 0))
    members = spark.createDataFrame([(7, n, len(t.split()) - 4) for n, t in texts.items()], "bucket long, node long, n long")
    frame = spark.createDataFrame(list(texts.items()), "row long, text string")
    found = {r.node: r.component for r in near_duplicates.linked(members, frame).collect()}
    assert found == {2 + 2 * g: 1 + 2 * g for g in range(30)}


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(170, 171), (171, 171)]
    found = {r.node: r.component for r in near_duplicates.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100), 171: 170}


@pytest.mark.parametrize("n", [3, 10, 60, 300])
def test_alignment_is_exact_and_order_counts(n):
    rng = random.Random(n)
    for _ in range(30):
        a = [rng.choice("abcdefghijklmnop") * 3 for _ in range(n)]
        b = edited(rng, a, rng.randint(0, max(1, n // 30)))
        if rng.random() < 0.3:
            b = b[n // 2 :] + b[: n // 2]
        x, y = (near_duplicates.labelled([w.encode() for w in t]) for t in (a, b))
        m = lcs(x.tolist(), y.tolist())
        s = m / (len(x) + len(y) - m)
        assert near_duplicates.aligned(x, y) == pytest.approx(s if s >= 0.8 else 0.0)


def test_sketches_find_similar_texts():
    rng = random.Random(9)
    missed = tried = 0
    for n in (8, 20, 60, 95, 105, 300, 1500):
        for _ in range(60):
            a = [f"w{rng.randrange(5000)}".encode() for _ in range(n)]
            b = [w if isinstance(w, bytes) else w.encode() for w in edited(rng, a, max(1, n // 45))]
            x, y = near_duplicates.labelled(a), near_duplicates.labelled(b)
            if near_duplicates.aligned(x, y):
                tried += 1
                missed += not set(near_duplicates.sketch(x).tolist()) & set(near_duplicates.sketch(y).tolist())
    assert tried > 200 and missed <= 1


def test_long_text_is_sketched_whole():
    words = [f"w{k % 7001}".encode() for k in range(120_000)]
    assert len(near_duplicates.labelled(words)) == len(words) - 4
    assert len(near_duplicates.sketch(near_duplicates.labelled(words))) == near_duplicates.KINDS[1][0]


def brute_search(rows, k):
    vectors = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]))
    lists = {}
    for q, asked in vectors:
        if q % 100 == 0:
            lists.setdefault(q, []).extend((-sum(a * b for a, b in zip(asked, v, strict=False)), i) for i, v in vectors if i != q)
    return sorted((q, r, i, -s) for q, found in lists.items() for r, (s, i) in enumerate(sorted(found)[:k], 1))


@pytest.mark.parametrize("block,chunk", [(8192, 2048), (150, 3)])
def test_impact_search_is_exact(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(impact_search, "BLOCK", block)
    monkeypatch.setattr(impact_search, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)]) for k in range(900)]
    rows += [(k, rows[7][1]) for k in range(900, 980)]
    rows += [(980, None), (981, [float("nan")] + [0.0] * 15), (1000, [None] + [0.1] * 15), (1100, [float("inf")] * 16), (None, rows[0][1])]
    rows += [(1200, [0.0] * 16), (1201, [0.5] * 4), (1202, []), rows[5], (5, rows[6][1]), (100, rows[6][1]), rows[200]]
    rows += [(301, rows[8][1])] * 400
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    vectors = impact_search.sound_vectors(frame)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in impact_search.search(vectors, vectors.where("vec_id % 100 = 0"), 10).collect())
    assert got == brute_search(rows, 10)


def test_search_stops_early_on_proof():
    rng = np.random.default_rng(2)
    data = rng.integers(-20, 20, (5000, 32))
    data[:12, 0] = 1000
    index = impact_search.Index(np.arange(5000), data)
    q = np.zeros(32, np.int64)
    q[0], q[1:] = 900, rng.integers(-3, 3, 31)
    ids, scores = index.search(-1, q, 10)
    want = np.lexsort((np.arange(5000), -(data @ q)))[:10]
    assert ids.tolist() == want.tolist() and (scores == (data @ q)[want]).all()


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(100, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for rows, n in ((frame, 1), (frame.limit(0), 0), (frame.where("vec_id = 100"), 0)):
        vectors = impact_search.sound_vectors(rows)
        assert impact_search.search(vectors, vectors.where("vec_id % 100 = 0"), 10).count() == n


def test_archives_round_trip(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n\r\n\r\n"
    rows = [(5, "http://a/ü b\r\nX: y", trap), (2, None, trap), (9, "c", "é👍\n" * 3), (1, "d", None), (7, "e", ""), (None, "f", trap), (8, "g", "long " * 200_000), (9, "c", "é👍\n" * 3)]
    rows += [(k, "u", f"page {k % 40}") for k in range(20, 120)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    warc.write(pages, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(found) == len(rows)
    texts = {r.payload_digest: r.payload for r in found if r.record_type == "response"}
    assert set(texts.values()) == {h or "" for _, _, h in rows}
    assert all(r.payload is None and r.refers_to_id for r in found if r.record_type == "revisit")
    ids = {r.record_id for r in found if r.record_type == "response"}
    assert {r.refers_to_id for r in found if r.record_type == "revisit"} <= ids
    got = sorted(map(str, warc.archive(pages).collect()))
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        data, original = (h or "").encode(), first[h or ""]
        kind = "response" if p == original else "revisit"
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((p, len(data), digest, kind, original if kind == "revisit" else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    text = sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, w, strict=True)) + ")" for w in want)
    assert got == text


def test_archives_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 100)
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    rows = [(k, None, f"{k} " + "x" * (k % 7 * 1000)) for k in range(300)] + [(k, None, f"{k}" * 40_000) for k in range(300, 310)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    counts = []
    for file in (tmp_path / "w").glob("*.txt"):
        payloads = [len(p) for _, p in warc.parsed(file.read_bytes())]
        assert len(payloads) <= 100 and (len(payloads) <= 1 or sum(payloads) <= 30_000)
        counts.append(len(payloads))
    assert sum(counts) == 310 and max(counts) > 10
    assert sorted((r.page_id, r.payload) for r in warc.read(spark, str(tmp_path / "w")).collect()) == [(p, h) for p, _, h in rows]


def test_no_pages_and_cut_archives(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parsed(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 90\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"))

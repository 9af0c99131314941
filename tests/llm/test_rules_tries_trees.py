"""URL rules, prefix trie and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import duckdb
import pytest

from corpusloom.llm import merkle, prefix_trie, url_rules
from corpusloom.llm import queries as llm
from corpusloom.llm.common import prepare
from corpusloom.llm.oracles import ORACLES
from tools.compare import TABLES, rows


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_merkle_manifest"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = llm.QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)


# --------------------------------------------------------------------------- URL rules

URLS = [
    (1, "https://News.Example.COM/en/a?x=1#top"), (2, "http://www.example.com/en/"), (3, "http://com"), (4, "http://a.net/fr/9.html"),
    (5, "ftp://notexample.com/en/x"), (6, None), (7, ""), (8, "no scheme/en/"), (9, "http://b.org/fr/1?u=http://com/"),
    (10, "x://example.com?en/"), (11, "http://ÄB.NET/es/"), (12, "http://net/es"), (12, "http://net/es"), (None, "http://q.net/es/\n/x"),
    (13, "http://c.org/" + "very/long/" * 20000),
]


def stated(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for r in llm.STATED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_stated_rules(spark):
    pages = spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, tokens string")
    got = url_rules.filtered(pages, llm.STATED).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"] or "") for r in got) == sorted(
        (i or 0, *stated(u)[:2], stated(u)[2] or "") for i, u in URLS
    )
    assert all(r["verdict"] == (stated(dict(URLS)[r["page_id"]])[3] or "allow") for r in got)
    assert url_rules.filtered(pages.limit(0), llm.STATED).count() == 0


def shop_urls(n, seed=5):
    """Shops that sell pills are bad under any host; a language alone says nothing."""
    rng = random.Random(seed)
    for i in range(n):
        bad = rng.random() < 0.4
        word = rng.choice(["cheap-pills", "pills-now", "free-pills"]) if bad else rng.choice(["cheap-books", "garden", "free-music"])
        yield i, f"http://{word}.host{rng.randrange(50)}.example/{rng.choice(['en', 'fr'])}/{i}", url_rules.BLOCK if bad else url_rules.ALLOW


def tokenized(spark, made):
    df = spark.createDataFrame(made, "page_id long, url string, label string")
    host, path = url_rules.address()
    return df.withColumn("host", host).withColumn("path", path).withColumn("tokens", url_rules.tokens())


def test_mined_rules_decide_unseen_urls(spark):
    rules = url_rules.mine(tokenized(spark, list(shop_urls(2000))).select("tokens", "label"))
    unseen = tokenized(spark, [(i, u.replace(".example", ".other"), v) for i, u, v in shop_urls(1000, 6)])
    got = url_rules.judged(unseen, rules).select("label", "mined").collect()
    assert sum(r["label"] == r["mined"] for r in got) >= 0.99 * len(got)
    assert not any(set(r.tokens) <= {"path:en", "path:fr", "word:cheap", "word:free"} for r in rules)


def test_mining_equals_brute_force(spark):
    rng = random.Random(3)
    sets = [(sorted({rng.choice("abcdefg") for _ in range(4)}), rng.choice([url_rules.ALLOW, url_rules.BLOCK])) for _ in range(400)]
    sets = [(t, url_rules.BLOCK if {"a", "b"} <= set(t) else v) for t, v in sets]
    got = url_rules.mine(spark.createDataFrame(sets, "tokens array<string>, label string"))
    least = max(url_rules.SUPPORT * len(sets), url_rules.LEAST_ROWS)
    sure = {}
    for n in range(1, url_rules.RULE_TOKENS + 1):
        for part in combinations("abcdefg", n):
            held = [v for t, v in sets if set(part) <= set(t)]
            for verdict in (url_rules.ALLOW, url_rules.BLOCK):
                both = held.count(verdict)
                if both >= least and both / len(held) >= url_rules.CONFIDENCE:
                    sure[part, verdict] = both / len(held)
    want = {
        k for k, c in sure.items()
        if not any(set(p) < set(k[0]) and v == k[1] and sure[p, v] >= c for p, v in sure)
    }
    assert want and {(r.tokens, r.verdict) for r in got} == want


def test_mining_leaves_out_no_token(spark):
    """More frequent tokens than 512, and many in one URL: a rule of the least telling ones is still found."""
    rows = [(["p", "q", *(f"t{i % 150}x{k}" for k in range(16))], url_rules.BLOCK) for i in range(3150)]
    rows += [(["p", *(f"t{i % 150}x{k}" for k in range(16))], url_rules.ALLOW) for i in range(60)]
    rows += [(["q", *(f"t{i % 150}y{k}" for k in range(2))], url_rules.ALLOW) for i in range(200)]
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    rules = {(r.tokens, r.verdict): r.confidence for r in got}
    assert rules[("p", "q"), url_rules.BLOCK] == 1.0 and len({t for r in got for t in r.tokens}) > 512


def test_index_finds_the_first_rule_that_fits():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rules = [url_rules.Rule(tuple(sorted(rng.sample(words, rng.randint(1, 3)))), rng.choice(["allow", "block"]), 1.0, 0.1) for _ in range(60)]
    index = url_rules.inverted(rules, {w: i for i, w in enumerate(words)})
    for _ in range(300):
        have = set(rng.sample(words, rng.randint(0, 6)))
        want = next(((i, r.verdict) for i, r in enumerate(rules) if set(r.tokens) <= have), None)
        assert url_rules.best_rule(index, have) == want


def test_no_labels_no_rules(spark):
    assert url_rules.mine(spark.createDataFrame([], "tokens array<string>, label string")) == []


# --------------------------------------------------------------------------- prefix trie


def grown(turns):
    convs = {}
    for c, n, role, text, *_ in turns:
        if c is not None:
            role, text = role or "", text or ""
            said = f"{len(role.encode())}:{role}{text}"
            convs.setdefault(c, []).append((n is not None, n or 0, role, hashlib.sha256(said.encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for node, here in members.items():
        under = [m for m in members if m[: len(node)] == node]
        out.append(
            (
                min(here), len(node), min(members[node[:-1]]) if node else None, len(here),
                sum(len(m) == len(node) + 1 for m in under), sum(not any(k[:-1] == m and k for k in members) for m in under),
                sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m),
                hashlib.sha256(",".join(str(c) for c in sorted(here) if len(convs[c]) == len(node)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, key string, depth int"


def trie_rows(spark, turns):
    df = spark.createDataFrame([(*t, "k", 7) for t in turns], TURNS)
    out = prefix_trie.trie(prefix_trie.regrown(prefix_trie.gathered(df)))
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_turns(seed, convs=60):
    rng = random.Random(seed)
    said = ["", None, "ja", "né", "x" * 9000]
    rows = []
    for c in rng.sample(range(330), convs):
        for n in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, rng.choice([n, n, n, 0, None]), rng.choice(["user", "bot", None]), rng.choice(said)))
    return rows + rows[:3] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("most", [10_000, 40, 1])
def test_trie_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie.bands, "__defaults__", (most,))
    turns = some_turns(most)
    assert trie_rows(spark, turns) == brute_trie(grown(turns))


def test_trie_of_a_hot_prefix_and_a_very_long_conversation(spark):
    turns = [(c, 0, "system", "be kind") for c in range(400)] + [(c, 1, "user", f"{c % 7}") for c in range(0, 400, 2)]
    turns += [(401, n, "user", "go on") for n in range(60)]
    assert trie_rows(spark, turns) == brute_trie(grown(turns))


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == []


def test_bands_cover_every_depth_once():
    lengths = {0: 3, 1: 50, 2: 500, 5: 30, 90: 2}
    for most in (1, 100, 400, 10**6):
        parts = prefix_trie.bands(lengths, most)
        assert [d for high, low, _ in parts for d in range(high, low, -1)] == list(range(90, -1, -1))
        for high, low, small in parts:
            entries = sum(n * (min(length, high) - low) for length, n in lengths.items() if length > low)
            assert not small or entries <= most
            assert small or high == low + 1


# --------------------------------------------------------------------------- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(docs):
    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def up(nodes):
        return [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(up(out[-1]))
        return out

    groups = {}
    for i, text, lang, source, n in docs:
        bare = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        key = (source is not None, (source or "").encode())
        groups.setdefault(key, []).append(((i is not None, i or 0), leaf(i, source, lang, n, text), leaf(i, source, lang, n, bare), i))
    trees = {k: levels([x[1] for x in sorted(rows)]) for k, rows in sorted(groups.items())}
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for at, (k, tree) in enumerate(trees.items()):
        for pos, (_, whole, changed, i) in enumerate(sorted(groups[k])):
            siblings, now = "", changed
            for levels_, place in ((tree, pos), (top, at)):
                for nodes in levels_[:-1]:
                    first = place - place % 3
                    left, right = "".join(nodes[first:place]), "".join(nodes[place + 1 : first + 3])
                    siblings, now, place = siblings + left + right, sha(left + now + right), place // 3
            out.append((i, whole, tree[-1][0], top[-1][0], sha(siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos int, grp string"


def manifest_rows(spark, docs):
    df = spark.createDataFrame([(*d, "d", 1, "g") for d in docs], DOCS)
    return sorted((tuple(r) for r in merkle.verified_rows(df).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    sources = [None, "", "a", "Z", "é", "\U0001f600"] + [f"s{i}" for i in range(9)]
    docs = [(i, rng.choice(["a\nb", "ab", None, "", "é\n"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([1, None])) for i in range(-20, 150)]
    docs += docs[:5] + [(None, "x\ny", None, None, None), (None, "x", "de", None, 1), (7, "\n" * 300_000, "en", "a", 3)]
    assert manifest_rows(spark, docs) == brute_manifest(docs)


def test_manifest_over_several_rounds(spark):
    docs = [(i, f"t{i}\n", "en", "hot" if i % 50 else f"s{i}", i) for i in range(2 * merkle.SPAN + 900)]
    assert manifest_rows(spark, docs) == brute_manifest(docs)


def test_manifest_of_one_row_and_none(spark):
    one = [(2, "a\n", "en", "s", 1)]
    assert manifest_rows(spark, one) == brute_manifest(one)
    assert manifest_rows(spark, []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 30])
def test_folding_hashes_nothing_on_the_left(n):
    digests = [sha(str(i)).encode() for i in range(n)]
    tree = merkle.Block(digests, merkle.levels_of(n))
    for i, d in enumerate(digests):
        assert tree.fold(i, d) == tree.nodes[-1][0]
        assert merkle.Above([(a.decode(), b.decode()) for a, b in tree.path(i)]).fold(d) == tree.nodes[-1][0]
        assert (tree.fold(i, sha("other").encode()) == tree.nodes[-1][0]) is False

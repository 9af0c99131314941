"""Quality models, source mix, packing, and the pipeline that joins them."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import mixing, near_duplicates, packing, pu_quality, quality_forest, queries, textstats
from corpusloom.llm.common import prepare, word_count

WORDS = public_tokenizers.path("word_bpe_49k.json")
WHITE = " \t\n\v\f\r"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


def split(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_counts(text):
    words = split(text)
    windows = collections.defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    repeated = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            duplicates += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, duplicates, len(repeated)


def odd_texts():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "é\xa0b c\x1cd", "x y z w v " * 3, "Und " * 40, "a b\na b\n a b\n\n\n", "#$ % |x|", "one " * 6]
    for _ in range(200):
        kinds = [f"w{k}" for k in range(rng.choice([2, 3, 8, 400]))]
        texts.append("".join(rng.choice(kinds) + rng.choice("  \n\t\v") for _ in range(rng.randint(1, 120))))
    return texts


def test_counts_equal_brute_force():
    for text in [*odd_texts(), "ab " * 30_000]:
        assert textstats.measure(text)[0] == brute_counts(text), text


def test_word_count_in_the_jvm(spark):
    texts = odd_texts()
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r.k: r.n for r in frame.select("k", word_count(F.col("text")).alias("n")).collect()}
    assert got == {k: len(split(t)) for k, t in enumerate(texts)}


def test_quality_models_on_given_tables(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_pu_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == q for p, q in tested) / len(tested) > 0.97
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    judged = queries.op2_quality_forest(spark, sf).collect()
    assert len(judged) == 1000
    for r in judged:
        counts = brute_counts(texts[r.doc_id])
        assert tuple(r[c] for c in textstats.COUNTS) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)
    sound = [(r.kept, labels[r.doc_id]) for r in judged if not r.base_failed and r.doc_id in labels]
    assert sum(k == q for k, q in sound) / len(sound) > 0.98
    assert all(k for k, q in sound if q == 1)


def test_stuttered_words_are_rejected_by_the_forest(spark):
    rng = random.Random(2)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]

    clean = [(k, " ".join(words(rng.randint(16, 90)))) for k in range(200)]
    stuttered = [(200 + k, " ".join(w for w in words(8) for _ in range(2 + k % 4))) for k in range(24)]
    docs = spark.createDataFrame(clean + stuttered, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(0, 224, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_forest.judge(docs, labels).collect()}
    assert not any(got[k].base_failed for k in got)
    assert [k for k in got if got[k].kept != (k < 200)] == []


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: round(r.score, 9) for r in pu_quality.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_the_risk_of_negatives_stays_above_zero(spark):
    """With far too high a prior the unbounded fit would take it below."""
    rng = np.random.default_rng(0)
    x = rng.random((600, len(textstats.FEATURES)))
    rows = spark.createDataFrame([(v.tolist(), bool(k < 300)) for k, v in enumerate(x)], "x array<double>, p boolean")
    model = pu_quality.minimised(rows, pu_quality.standardised(rows), 0.999)
    f = pu_quality.design(model, x) @ model.weights
    risk = np.logaddexp(0, f).mean() - 0.999 * np.logaddexp(0, f[:300]).mean()
    assert np.isfinite(model.weights).all() and model.weights.any() and risk >= 0


def test_quality_models_of_odd_rows(spark):
    rows = [(1, "a b c"), (1, "other words"), (None, "x"), (2, None), (3, ""), (4, "w " * 100_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, stats string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    none = labels.limit(0)
    for marks in (labels, none):
        assert sorted(r.score for r in pu_quality.classify(docs, marks).collect()) == [0.5] * 6
        got = quality_forest.judge(docs, marks).collect()
        assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)
    assert pu_quality.classify(docs.limit(0), labels).count() == 0
    assert quality_forest.judge(docs.limit(0), labels).count() == 0
    trusted = spark.createDataFrame([(k, 1) for k in (1, 4)], "doc_id long, quality int")
    scores = pu_quality.classify(docs, trusted).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)


def test_path_lengths_of_a_tree():
    points = np.array([[0.0], [0.0], [0.0], [10.0]])
    forest = quality_forest.plant(points)
    scores = quality_forest.anomaly(forest, points)
    assert scores[3] > scores[0] == scores[1] and (quality_forest.anomaly(forest, points[::-1]) == scores[::-1]).all()
    assert quality_forest.separating({(100, 1): 50, (600, 0): 5, (700, 1): 1}) == pytest.approx(0.35, abs=0.002)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            target.update({s: weight[s] * share for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def mixed_documents():
    rng = random.Random(8)
    rows = []
    for source, n, most in (("a", 4, 30), ("Z", 300, 60), ("é", 50, 9), ("𝄞", 30, 300), ("ﬀ", 3, 2), (None, 40, 40), ("empty", 5, 0), ("b", 200, 1)):
        rows += [(len(rows) + k, "w " * rng.randint(0, most), source) for k in range(n)]
    rows += [(2000 + k, "same text here", "Z") for k in range(400)] + [rows[10], rows[10], (None, None, "a"), (None, "x y", "a"), (5000, "v " * 50_000, "𝄞")]
    return rows


def test_mix_meets_its_targets(spark):
    rows = mixed_documents()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix(docs, keep=("source",)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    target, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken in {k * r.size for k in range(4)}
        taken[r.source] += r.taken
    for s, t in target.items():
        # One document of that source is longer than the target; the others are taken three times.
        assert abs(taken[s] - (3 * (sizes[s] - 50_000) if s == "𝄞" else t)) <= 1, (s, taken[s], t)
    again = mixing.mix(docs.repartition(7), keep=("source",)).collect()
    count = lambda rows: collections.Counter((r.doc_id, r.size, r.source, r.taken) for r in rows)
    assert count(again) == count(got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_knapsack_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(1, 120)
        take = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for length, count in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * length for s in sums for k in range(count + 1)}
        assert (take <= counts).all() and take @ lengths == max(s for s in sums if s <= budget)
        if budget < lengths @ counts:
            whole = mixing.fitted(lengths, counts, 2 * counts, budget)
            assert (0 <= whole).all() and (whole <= 2 * counts).all() and whole @ lengths <= budget


def test_tightest_room_and_best_fit():
    rng = random.Random(6)
    for most in (7, 8, 100):
        tree, rooms = packing.Capacities(most), collections.Counter()
        for step in range(400):
            if rng.random() < 0.5:
                room = rng.randint(0, most)
                tree.put(room, step)
                rooms[room] += 1
            else:
                need = rng.randint(1, most)
                want = min((r for r, n in rooms.items() if n and r >= need), default=None)
                found = tree.take(need)
                assert (found and found[1]) == want
                if found:
                    rooms[want] -= 1
    sequences, offsets = packing.best_fit([6, 5, 5, 4, 3, 3, 2, 2], 10)
    assert sequences == [0, 1, 1, 0, 2, 2, 2, 2] and offsets == [0, 0, 5, 6, 0, 3, 6, 8]


def test_pieces_and_sequences(spark, monkeypatch):
    texts = ["The quick brown FOX, it's 12.5!", None, "", "word " * 9000, "A<|endoftext|>b. İ é. <|STARTOFTEXT|>", " \n", "x " * 4095, "y " * 4096]
    texts += [t for t in odd_texts() if t]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, "no id")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    cut = packing.pieces(docs, WORDS)
    tokenizer = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[doc_id, k, at, len(ids[at : at + 4096]), ids[at : at + 4096].tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in cut.collect()) == want
    monkeypatch.setattr(packing, "GROUP", 60)
    packed = packing.pack(cut).collect()
    assert len(packed) == sum(want.values())
    used = collections.defaultdict(list)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    monkeypatch.undo()
    best = packing.pack(cut)
    total = sum(r.length for r in packed)
    assert best.select("sequence_id").distinct().count() <= math.ceil(total / 4096) + 1
    joined = packing.sequences(best).collect()
    assert sum(r.length for r in joined) == total and all(4 * r.length == len(r.ids) for r in joined)
    assert packing.pack(packing.pieces(docs.limit(0), WORDS)).count() == 0


def test_a_worker_forgets_words_and_still_knows_them(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    monkeypatch.setattr(packing, "BATCH_BYTES", 200)
    ids, texts = packing.Ids(WORDS), [t for t in odd_texts()]
    want = [np.array(ids.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ids.of(texts)) == want and list(ids.of(texts)) == want


def test_a_small_store_stays_small_and_gives_the_same_ids():
    texts = [" ".join(f"word{(7 * k + j) % 900}" for j in range(20)) + "." for k in range(200)]
    ids, kept, got = packing.Ids(WORDS, known=60, batch=100), [], []
    for found in ids.of(texts):
        got.append(found)
        kept.append(max(len(ids.known), len(ids.before)))
    assert got == list(packing.Ids(WORDS).of(texts)) and max(kept) <= 80  # the words of a text may come on top
    assert corpus_pipeline.KNOWN_WORDS < packing.KNOWN_WORDS


def test_new_words_reach_the_tokenizer_in_bounded_lots(monkeypatch):
    monkeypatch.setattr(packing, "ENCODED_WORDS", 40, raising=False)
    ids, lots = packing.Ids(WORDS), []
    encoded = ids._encoded
    monkeypatch.setattr(ids, "_encoded", lambda words: lots.append(len(words)) or encoded(words))
    text = " ".join(f"word{k}" for k in range(150))
    whole = np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert list(ids.of([text])) == [whole] and sum(lots) == 150 and max(lots) <= 40


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    expected = {r.doc_id for r in queries.op9_pu_quality(spark, sf).where("predicted = 1").collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, sf).cache()
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == expected
    kept = stages["quality_rules"](spark, good, sf).cache()
    rules = {r.doc_id for r in queries.op2_quality_forest(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == expected & rules
    single = stages["near_duplicate_removal"](spark, kept, sf).cache()
    classes = {r.doc_id: r.class_id for r in near_duplicates.classes(kept).collect()}
    assert {r.doc_id for r in single.collect()} == set(classes.values())
    mix = stages["source_mix"](spark, single, sf).cache()
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(single).collect() if r.taken}
    assert collections.Counter(r.doc_id for r in mix.collect()) == times
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in mix.collect())
    packed = stages["best_fit_packing"](spark, mix, sf)
    assert collections.Counter(r.doc_id for r in packed.where("piece = 0").collect()) == times


def test_pipeline_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

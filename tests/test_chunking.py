"""Structure of legal texts: expected chunks and invariants."""

import re

import pytest

from corpusloom.config import Options
from corpusloom.operators import chunking
from corpusloom.plans import workload as w

SCHEMA = "tenant_id string, document_id string, page int, text string"


def chunks(spark, *pages, **options):
    rows = [("t", "d", i, text) for i, text in enumerate(pages, 1)]
    out = chunking.chunk_pages(spark.createDataFrame(rows, SCHEMA), Options(**options))
    return out.orderBy("chunk").collect()


def test_chapter_and_articles(spark):
    got = chunks(spark, "CAPÍTULO I\nDISPOSIÇÕES\nArt. 1º O registro.\nArt. 2º A guarda.")
    assert [r["article"] for r in got] == [None, "Art. 1º", "Art. 2º"]
    assert all(r["chapter"] == "CAPÍTULO I" for r in got)
    assert [r["chunk"] for r in got] == [1, 2, 3]
    assert got[1]["chunk_id"] == "t:d:2"


def test_heading_resets_below(spark):
    got = chunks(spark, "# Norma\n## Parte\n### Seção A\nArt. 1 x\n## Outra\ntexto")
    last = got[-1]
    assert (last["title"], last["chapter"], last["section"], last["article"]) == ("Norma", "Outra", None, None)


def test_annex_keeps_title_only(spark):
    got = chunks(spark, "# Norma\nCAPITULO I\nArt. 1 x\nANEXO II\ntabela")
    assert (got[-1]["title"], got[-1]["annex"], got[-1]["chapter"], got[-1]["article"]) == ("Norma", "ANEXO II", None, None)


def test_items_label_a_page_start(spark):
    got = chunks(spark, "§ 1º O prazo.\nI - primeiro;\na) alínea\nArt. 3 fim")
    assert got[0]["paragraph"] == "§ 1º" and got[0]["inciso"] is None
    assert got[1]["article"] == "Art. 3" and got[1]["paragraph"] is None


def test_bare_article_joins_the_next(spark):
    got = chunks(spark, "Art. 1\nArt. 2 Texto.\nArt. 3\nArt. 4\nArt. 5 Fim.\nArt. 6")
    assert [r["body"] for r in got] == ["Art. 1\nArt. 2 Texto.", "Art. 3\nArt. 4", "Art. 5 Fim."]
    assert got[0]["article"] == "Art. 1"


def test_pages_restart_the_context(spark):
    got = chunks(spark, "CAPITULO I\nArt. 1 x", "continua sem marca")
    assert got[-1]["chapter"] is None and got[-1]["chunk"] == 3


def test_long_article_is_packed_with_overlap(spark):
    sentences = [f"A frase numero {i} tem um tamanho razoavel." for i in range(80)]
    got = chunks(spark, "Art. 1 " + " ".join(sentences), chunk_chars=400, overlap_chars=60)
    assert len(got) > 5
    assert all(len(r["body"]) <= 400 + 60 + 2 for r in got)
    for before, after in zip(got, got[1:]):
        assert after["body"].startswith(before["body"][-60:].strip()[:20])
    text = " ".join(r["body"] for r in got)
    assert all(s in text for s in sentences)


def test_hard_cut_covers_a_word_without_end(spark):
    got = chunks(spark, "x" * 1000, chunk_chars=300, overlap_chars=50)
    assert max(len(r["body"]) for r in got) <= 300 + 50 + 2
    assert sum(len(r["body"]) for r in got) >= 1000


def test_bad_overlap_is_refused(spark):
    with pytest.raises(ValueError):
        chunks(spark, "x", chunk_chars=10, overlap_chars=10)


def test_corpus_invariants(spark, sf):
    pages = w.corpus_pages(spark, sf)
    rows = chunking.chunk_pages(pages).select("tenant_id", "document_id", "chunk", "body").collect()
    assert not [r for r in rows if re.fullmatch(r"(?i)\s*Art\.?\s*\d+\s*[ºo°]?\s*[.\-–—]?\s*", r["body"])]
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["tenant_id"], r["document_id"]), []).append(r["chunk"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_doc.values())
    assert {tuple(r) for r in pages.select("tenant_id", "document_id").collect()} == set(by_doc)


def test_one_shuffle_for_the_whole_chain(spark):
    pages = spark.createDataFrame([("t", "d", 1, "Art. 1 x")], SCHEMA)
    plan = chunking.chunk_pages(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

"""Main texts, chat examples and token counts."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from corpusloom.llm import html_text, preferences, trie_counts
from corpusloom.llm.common import prepare

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    prepare(spark)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="x"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div><div class="wrap w-12"><div id="sidebar"><p>Side text that is long enough</p></div>
<article class="post post-%d"><header><h1>Title&nbsp; of
it</h1></header><p><b>One &lt;two&gt; <a href="x">link</a>.<br><p>Second   par&eacute; text of the article, longer.
<div hidden>secret</div><ul><li>first<li>second</ul><form><input value="q">Search</form><table><tr><td>x<td>y</table>
<section id="comments"><p>Reader says a very long comment indeed, longer than the text itself, over and over again.</p></section>
</article></div><aside>More</aside><footer>&copy; 2024</footer></body>"""
TEXT = "Title of it\nOne <two> link.\nSecond paré text of the article, longer.\nfirst\nsecond\nx y"


def test_extract_leaves_boilerplate_out():
    assert html_text.extract(PAGE % 3, [])[0] == TEXT


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div", ""), ("1 < 2 <b>x", "1 < 2 x"), ("<script>x", ""), ("<!-- x", "")])
def test_extract_of_odd_pages(page, text):
    assert html_text.extract(page, [])[0] == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>Text before <select><option>a</option></select> and after</p>", "Text before\nand after"),
        ('<h1>Title <span class="share"><ul><li>x</ul></span></h1><p>body</p>', "Title\nbody"),
        ('<p>text <span class="ad">x</p><p>more</p>', "text\nmore"),
        ("<table><tr><td>a<td><button>b<p>c</p></button></table>", "a"),
    ],
)
def test_text_before_inline_boilerplate_is_kept(page, text):
    assert html_text.extract(page, [])[0] == text


STORY = "<p>A story of the page, told in sentences that are long enough.</p>" * 4
AROUND = '<div id="top"><p>Site of the day</p></div>%s<div class="sidebar"><p>Side text</p></div>'


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="content-sidebar-wrap"><div>%s</div></div>',
        '<div class="sidebar-wrap"><article>%s</article></div>',
        '<div class="site has-sidebar"><div>%s</div></div>',
        '<div class="no-comments"><main>%s</main></div>',
        '<div class="sidebar-layout"><div class="overlay"><div class="text">%s</div></div></div>',
        '<form action="x"><input type="hidden" value="y"><div class="box">%s</div></form>',
        '<form><div class="toolbar-page"><article>%s</article></div></form>',
        '<table><tr><td class="widget"><div>%s</div></td><td class="nav">Menu</td></tr></table>',
    ],
)
@pytest.mark.parametrize("around", ["%s", AROUND])
def test_marked_wrapper_keeps_its_article(wrapper, around):
    text = html_text.extract(f"<body>{around % (wrapper % STORY)}</body>", [])[0]
    assert text.count("A story") == 4 and "Side text" not in text and "Menu" not in text


@pytest.mark.parametrize(
    "noise",
    [
        '<div id="comments"><ol><li><div>%s</div></li></ol></div>',
        '<div class="no-print comments"><article class="comment">%s</article></div>',
        '<div class="cookie-notice">We use cookies</div>',
        '<form class="comment-form"><p>Say something</p></form>',
        '<div class="related"><article class="post"><p>Read this too.</p></article></div>',
    ],
)
def test_marked_blocks_beside_an_article_stay_out(noise):
    noise = noise.replace("%s", "<p>What a reader says about it, at great length.</p>" * 30)
    text = html_text.extract(f'<body><div class="text">{STORY}</div>{noise}</body>', [])[0]
    assert text.split("\n") == ["A story of the page, told in sentences that are long enough."] * 4
    assert html_text.extract('<div class="cookie-notice"><p>We use cookies</p></div>', [])[0] == ""


PART = "<p>Part %d of the story is told here, in a paragraph that is long enough to be text beyond any doubt.</p>"
BLOCKS = ['<div class="elementor-widget"><div class="elementor-widget-container">%s</div></div>', '<div class="widget_text">%s</div>', '<section class="widget">%s</section>']


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("page", ["<body><div>%s</div></body>", "<body><article>%s</article></body>", "<body><main><h1>Head</h1><p>By A.</p>%s</main></body>"])
def test_pages_of_builder_blocks_are_whole(block, page):
    menu = block % '<p><a href="/a">One link and another</a></p><p><a href="/b">One more</a></p>'
    whole = page % ("".join(block % (PART % k) for k in range(3)) + menu)
    text = html_text.extract(whole, [html_text.vote(whole)])[0]
    assert [k for k in range(3) if f"Part {k} of" in text] == [0, 1, 2] and "One more" not in text


def test_builder_blocks_beside_an_article_stay_out():
    side = "".join(BLOCKS[0] % "<p>Things that happen elsewhere on this site, told briefly.</p>" for _ in range(4))
    assert "elsewhere" not in html_text.extract(f"<body><article>{PART % 1}{PART % 2}</article><div>{side}</div></body>", [])[0]


@pytest.mark.parametrize("section", ['<section id="discussion"><h2>4. Discussion</h2>%s</section>', '<div class="related-work"><h3>Related work</h3>%s</div>'])
def test_sections_of_a_study_are_text(section):
    page = f"<body><article>{PART % 1}{section % (PART % 2)}{PART % 3}</article></body>"
    assert "Part 2" in html_text.extract(page, [])[0]
    said = section % f'<div class="comment">{PART % 4}</div>'
    assert "Part 4" not in html_text.extract(page.replace(section % (PART % 2), said), [])[0]
    unnamed = section.replace("4. Discussion", "12 replies").replace("Related work", "Read this too")
    assert "Part 2" not in html_text.extract(page.replace(section % (PART % 2), unnamed % (PART % 2)), [])[0]


def test_an_article_in_differently_named_blocks_is_whole():
    parts = "".join(f'<div class="{name}">{PART % k}{PART % k}</div>' for k, name in enumerate(("intro", "method", "findings")))
    got = html_text.extract(f'<body><div class="content"><h1>Head</h1>{parts}</div><div class="about"><p>About this site.</p></div></body>', [])[0]
    assert got.split("\n")[0] == "Head" and all(got.count(f"Part {k} of") == 2 for k in range(3)) and "About" not in got


def test_generalised_paths_ignore_numbers():
    assert html_text.vote(PAGE % 3) == html_text.vote(PAGE % 77) == "body.x>div.w.wrap>article.post"


def test_winning_path_of_the_host_is_used(spark):
    usual = '<body><div class="text"><p>The story, told at length, sentence by sentence.</p></div><div class="box"><p>box</p></div></body>'
    odd = '<body><div class="text"><p>Short story.</p></div><div class="box"><p>A box that holds much more words than the story does.</p></div></body>'
    rows = [(k, "http://Host.example/%d" % k, usual) for k in range(5)] + [(9, "https://host.example:80/9", odd), (10, None, odd), (11, "http://host.example/", None)]
    rows.append(rows[0])
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, path int")
    got = html_text.main_texts(pages.select("page_id", "url", "html")).collect()
    assert len(got) == len(rows)
    found = {r.page_id: r for r in got}
    assert found[9].text == "Short story." and found[9].path == "body>div.text"
    assert found[10].text.startswith("A box")
    assert found[11].text == "" and found[11].n_chars == 0
    assert html_text.main_texts(pages.limit(0)).count() == 0
    assert html_text.main_texts(pages).count() == len(rows)  # other columns, though they clash, are ignored


def test_each_template_of_a_host_keeps_its_article(spark):
    words = "<p>Whole sentences of the report, one after another, which fill the page.</p>" * 5
    first = f'<body><div class="content">{words}</div></body>'
    second = f'<body><article><h1>Head</h1>{words}</article><div class="content"><p>A few words.</p></div></body>'
    rows = [(k, None, first if k < 6 else second) for k in range(10)]
    rows += [(k, "http://few.example/", first if k < 13 else second) for k in range(10, 14)]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        second_kind = 6 <= r.page_id < 10 or r.page_id == 13
        assert r.text.count("Whole sentences") == 5 and r.path == ("body>article" if second_kind else "body>div.content")


def test_agreed_path_goes_before_a_part_of_it():
    page = f'<body><div class="text"><p>First.</p><div class="list"><p>{"Many words. " * 9}</p></div><p>Last.</p></div></body>'
    outer, inner = "body>div.text", "body>div.text>div.list"
    assert html_text.extract(page, [outer, inner], [9, 2])[1] == outer
    assert html_text.extract(page, [inner, outer], [9, 2])[1] == inner


def test_long_page():
    page = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>" + "<div>" * 5000
    assert html_text.extract(page, [])[0].count("\n") == 19_999


def turns_of(rows):
    def key(r):
        return tuple((x is not None, x) for x in r)

    return [(role, text) for _, role, text in sorted(((t, r or "unknown", x or "") for t, r, x in rows), key=lambda r: ((r[0] is not None, r[0] or 0), key(r[1:])))]


def example(c, r):
    c, r = turns_of(c), turns_of(r)
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def show(turns):
        return "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns)

    def mask(turns):
        return [x for a, b in turns for x in ((13 + len(a), 0), (len(b) + 10, int(a == "assistant")), (1, 0))]

    return n, show(c[:n]), show(c[n:]), show(r[n:]), mask(c[n:]), mask(r[n:])


def test_preference_examples(spark):
    rng = random.Random(1)
    sides = ({}, {})
    for pair in [*range(40), None]:
        said = [(t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é" * 30])) for t in range(rng.randint(0, 6))]
        for side in sides:
            kept = said[: rng.randint(0, len(said))]
            side[pair] = kept + [(rng.choice([None, 9, 9]), "assistant", rng.choice("xyz")) for _ in range(rng.randint(0, 2))]
    sides[0][50] = [(0, "assistant", "long " * 50_000)]

    def frame(side):
        rows = [(p, *t, "clash") for p, ts in side.items() for t in ts]
        return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, side string")

    got = preferences.preference_examples(frame(sides[0]), frame(sides[1])).collect()
    pairs = {p for s in sides for p, ts in s.items() if ts}
    assert {r.pair_id for r in got} == pairs and len(got) == len(pairs)
    for r in got:
        want = example(sides[0].get(r.pair_id, []), sides[1].get(r.pair_id, []))
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask]) == want
        assert sum(x.chars for x in r.chosen_mask) == len(r.chosen)
    empty = frame({})
    assert preferences.preference_examples(empty, empty).count() == 0
    plan = preferences.preference_examples(frame(sides[0]), frame(sides[1]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_forward_scores_agree_with_a_unigram_model():
    pieces = trie_counts.zipf_pieces(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    unknown = [("<unk>", 0.0)]
    byte_pieces = [(f"<0x{k:02X}>", -100.0) for k in range(256)]
    # The least score decides the unknown penalty, so byte pieces may not lower it.
    least = min(pieces.values())
    plain = Tokenizer(models.Unigram([*unknown, *((p, least) for p, _ in byte_pieces), *pieces.items()], unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCé,.0189漢字👍"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)] + ["internationalization", "the"]
    trie = trie_counts.Trie(pieces)
    assert model.get_piece_size() == 32000
    for word in words:
        assert trie.insert("▁" + word) == len(plain.encode(word).ids), word


def test_prefixes_are_scored_once_and_a_full_trie_starts_anew(monkeypatch):
    trie = trie_counts.Trie({"▁": -1.0, "a": -2.0, "ab": -2.5, "▁ab": -2.0})
    assert trie.tokens([b"ab", b"abab", b"ab", b"aba"]) == 1 + 2 + 1 + 2
    assert len(trie.score) == 1 + 5
    words = [str(k).encode() for k in range(300)]
    whole = trie.tokens(words)
    monkeypatch.setattr(trie_counts, "NODES", 20)
    assert trie_counts.Trie(trie.pieces).tokens(words) == whole


def test_token_counts_of_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x" * 100_000), (4, " \t\n")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in trie_counts.token_counts(docs, PIECES).collect()}
    assert trie_counts.token_counts(docs, PIECES).count() == 6
    assert got[1].n_pretokens == 2 and got[None].n_tokens == got[2].n_tokens == got[4].n_tokens == 0
    assert got[3].n_pretokens == 1 and got[3].n_tokens > 10_000
    assert trie_counts.token_counts(docs.limit(0), PIECES).count() == 0

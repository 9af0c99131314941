"""Main text of HTML pages by consensus host paths.

Every page is parsed once to score its containers: a paragraph gives its text, less the
text of links, to its parent, half of it to the parent's parent and a third one level up;
``article`` and ``main`` count double. The best container, widened while its parent adds
nothing but headings or, within content, long paragraphs of text, names a generalised path (tags with their classes, digits
removed). Spark counts these votes by host; paths with at least a twentieth of a
host's votes win, which leaves at most twenty a host. Then every page is parsed
again. Of the winning paths that it contains, and that hold text, the one whose container scores
best on that page gives the text; a page without one keeps its own best container.
Around that container a winning path of more votes goes first, so that no part is cut from an article.
A path that won by a single vote, which may be the odd page's own, has to score better by
its odds: a container with n votes outweighs it up to n times.

Boilerplate never scores and is never extracted: menus, page headers and footers,
sidebars, forms, scripts, notices, adverts, shared links, comments and hidden elements, told by
tag, role, or a whole word of class or id.

A block that its names or the tag ``form`` mark may still be a wrapper of the page. Its text is read
apart, and ``relieve`` makes the block a plain container if the page's text turns out to lie in it. Blocks of one path
that are marked by the same words are judged together. A study's section "Discussion" or "Related work" is text.

Edge cases: a null or empty html gives an empty text; a page without containers gives
the text of its body. A null url is the host ''. Repeated rows are extracted one by one.
Ties between containers go to the earlier one, between paths to more votes, then to
the smaller path. Other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.session import written

#: Share of a host's votes that a path needs.
LEAST_SHARE = 0.05
#: Depth up to which elements are nested; deeper ones are read as if they were at this depth.
DEPTH = 200

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "svg", "math", "xmp")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input label map menu meter nav noscript object progress "
    "select svg template textarea video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
# Words of class and id names that mark boilerplate.
NOISE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disqus donate footer gdpr hidden login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination paywall popup print promo promos promotion recommendations recommended "
    "related replies reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored sponsors subscribe "
    "subscription tags teaser toc toolbar topbar widget widgets".split()
)
# Words that mark what readers say; such a block is a wrapper only if no other text is sound.
READERS = frozenset("comment comments discussion disqus replies reply respond".split())
# Words by which page builders mark every block, and words that mark sections of studies too.
BUILDERS, STUDIES = frozenset(("widget", "widgets")), frozenset(("discussion", "related"))
# Headings of such sections.
STUDY = re.compile(r"(?:[0-9.]+ )?(?:(?:general |results and )?discussion(?: and conclusions?)?|related (?:work|works|literature|research|studies))", re.I)
#: Length from which a paragraph is text beyond doubt, if at most a quarter of it is links.
LONG = 80
#: How often a container in a marked block has to outscore all sound ones; ``article``, ``main`` and wrappers by name once.
OUTSCORE = 10
# Class and id names that describe a layout, and names of wrappers.
LAYOUT = re.compile(r"(?:has|no|with|without)[-_].*|(?:content|main|article|entry)[-_]sidebar[-_](?:wrap|wrapper|container|layout|inner)", re.I)
WRAPS = re.compile(r"(?:\S*[-_])?(?:wrap|wrapper)(?:[-_]\S*)?", re.I)
#: Words of class and id names of elements whose ``header`` belongs to the text.
CONTENT = frozenset("article content entry main post story".split())
# Elements that can wrap a page.
WRAPPERS = frozenset("center div fieldset form li ol section table tbody td tr ul".split())
# Elements whose start ends an open paragraph, item, cell or row.
CLOSES_P = BLOCK - {"body", "head", "html", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
CLOSES = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "tr": ("tr",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("thead", "tbody", "tfoot"),
    "tfoot": ("thead", "tbody", "tfoot"),
}
SCOPES = frozenset("ul ol dl table article section div main body html td th blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<[!?][^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*+\"|=\s*'[^']*+'|[^>])*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/]|\Z)", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "path", "parent", "noise", "order", "headings", "own", "score", "text", "links", "long", "depth", "inside", "names", "soft")

    def __init__(self, tag: str, path: str, parent: Element | None, noise: bool, order: int):
        self.tag, self.path, self.parent, self.noise, self.order = tag, path, parent, noise, order
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent) and parent.inside
        self.score, self.text, self.links, self.long, self.headings = 0.0, 0, 0, 0, 0
        #: Marked as boilerplate itself by names or tag, its names, and the innermost such block that holds it.
        self.own, self.names, self.soft = False, "", parent.soft if parent else None


def noisy(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in SKIPPED or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return tag not in WRAPPERS and marked(attributes)


def marked(attributes: dict[str, str]) -> bool:
    """Class or id has a word of boilerplate, layout names aside."""
    named = " ".join(n for n in names_of(attributes).split() if not LAYOUT.fullmatch(n))
    return not NOISE.isdisjoint(split(named))


def names_of(attributes: dict[str, str]) -> str:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}"


def split(named: str) -> list[str]:
    return SPLIT.split(CAMEL.sub(" ", named).lower())


def words_of(attributes: dict[str, str]) -> list[str]:
    """Words of an element's class and id."""
    return split(names_of(attributes))


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes; digits and order do not matter."""
    classes = sorted({re.sub(r"[-_]*\d+", "", c) for c in attributes.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


def lineage(e: Element | None) -> Iterator[Element]:
    """An element and what holds it, innermost first."""
    while e is not None:
        yield e
        e = e.parent


def shared(a: Element, b: Element) -> Element:
    """The innermost element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent or b
        else:
            b = b.parent or a
    return a


def credit(holder: Element, size: int, share: int, heading: bool) -> None:
    """Count a block for its containers, up to the innermost marked one."""
    soft = holder.soft
    long = size if holder.tag == "p" and size >= LONG and 4 * share <= size and not heading else 0
    for e in lineage(holder):
        if e.soft is not soft:
            break
        e.text += size
        e.links += share
        e.long += long
        e.headings += size if heading else 0
    if heading:
        return
    # A paragraph scores for what holds it; bare text scores for its own element.
    at = holder.parent if holder.tag in ("p", "li", "pre", "dd", "dt", "blockquote", "td", "th") and holder.parent else holder
    for part in (1, 2, 3):
        if at is None or at.soft is not soft:
            break
        at.score += (size - share) / part
        at = at.parent


def wrappers(e: Element | None) -> Iterator[Element]:
    """The marked blocks around an element, itself included."""
    soft = e.soft if e else None
    while soft is not None:
        yield soft
        soft = soft.parent.soft if soft.parent else None


def weigh(elements: list[Element], sizes: list[tuple[Element, int, int, bool]]) -> None:
    for e in elements:
        e.score, e.text, e.links, e.long, e.headings = 0.0, 0, 0, 0, 0
        e.soft = e if e.own else e.parent.soft if e.parent else None
    for block in sizes:
        credit(*block)


def alike(e: Element) -> tuple[str, frozenset[str]]:
    """What marked blocks that are judged together share: path and words of boilerplate."""
    return e.path, NOISE.intersection(split(e.names))


def free_sections(elements: list[Element], blocks: list[tuple[Element, str, bool]]) -> bool:
    """Make sections of a study plain containers. Was there one?

    Such a section stands in an ``article`` or ``main``, has its own heading, few links and no marked block in it.
    """
    titles = dict[Element, str]()
    for holder, text, heading in blocks:
        if heading and holder.soft is not None:
            titles.setdefault(holder.soft, text)
    outer = {w for e in elements if e.own and e.parent for w in wrappers(e.parent)}
    found = False
    for e, title in titles.items():
        held = any(a.tag in ("article", "main") for a in lineage(e))
        if held and e not in outer and STUDY.fullmatch(title) and 4 * e.links <= e.text and STUDIES.issuperset(alike(e)[1]):
            e.own, found = False, True
    return found


def relieve(elements: list[Element], sizes: list[tuple[Element, int, int, bool]], blocks: list[tuple[Element, str, bool]]) -> None:
    """Make marked blocks plain containers where they wrap the text of the page; the rest is boilerplate.

    A form does if most of the paragraphs lie in it. Any block does if a container in it outscores all
    sound ones: an article, main or one in a wrapper by name at all, others ``OUTSCORE`` times or, like what
    readers say, only where nothing is sound. The blocks of a page builder count together; where a block is freed, so are
    all that are ``alike``, but for those that are mostly links.
    """
    if free_sections(elements, blocks):
        weigh(elements, sizes)
    total, inside = 0, dict[Element, int]()
    for holder, size, share, heading in sizes:
        if not heading:
            total += size - share
            for w in wrappers(holder):
                if w.tag == "form" and NOISE.isdisjoint(split(w.names)):
                    inside[w] = inside.get(w, 0) + size - share
    forms = [w for w, n in inside.items() if 2 * n > total]
    for w in forms:
        w.own = False
    if forms:
        weigh(elements, sizes)
    sound = max((value(e) for e in elements if e.score and not e.noise and e.soft is None), default=0.0)
    built = dict[tuple[str, frozenset[str]], list[float]]()
    for e in elements:
        if e.own and e.score and not e.noise and alike(e)[1] <= BUILDERS and all(alike(w)[1] <= BUILDERS for w in wrappers(e)):
            built.setdefault(alike(e), []).append(value(e))
    top, most = None, 0.0
    for e in elements:
        if e.noise or e.soft is None or not e.score:
            continue
        group = built.get(alike(e), []) if e.own else []
        if (worth := sum(group) if len(group) > 1 else value(e)) <= most:
            continue
        around = list(wrappers(e))
        readers = any(not READERS.isdisjoint(split(w.names)) for w in around)
        if sound:
            plain = e.tag in ("article", "main") and NOISE.isdisjoint(split(e.names))
            plain = plain or e.soft is not e and all(any(WRAPS.fullmatch(n) for n in w.names.split()) for w in around)
            if readers or worth <= sound * (1 if plain else OUTSCORE) or e.own and len(group) < 2:
                continue
        elif e.own and not e.inside and len(group) < 2:
            continue
        top, most = e, worth
    if top is not None:
        freed = set(wrappers(top))
        kinds = {alike(w) for w in freed}
        sisters = [e for e in elements if e.own and e not in freed and alike(e) in kinds]
        for e in (*freed, *sisters):
            e.own = False
        weigh(elements, sizes)
        listed = [e for e in sisters if 2 * e.links > e.text]
        for e in listed:
            e.own = True
        if listed:
            weigh(elements, sizes)
    for e in elements:
        e.noise = e.noise or e.soft is not None


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str, bool]]]:
    """Elements in page order, and blocks (innermost element, text, heading) outside boilerplate."""
    root = Element("html", "", None, False, 0)
    elements, blocks, sizes, stack = [root], [], [], [root]
    run: list[str] = []
    read: Element | None = None  # what was open when the text in ``run`` was read
    soft: list[Element | None] = [None]
    linked = [0]
    links = 0

    def add(text: str) -> None:
        nonlocal read
        if run and stack[-1].soft is not soft[0]:
            flush()
        soft[0] = stack[-1].soft
        run.append(text)
        if not text.isspace() and read is not stack[-1]:
            read = stack[-1] if read is None else shared(read, stack[-1])

    def flush() -> None:
        nonlocal run, read
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run = []
            if text:
                above = list(lineage(read or stack[-1]))
                holder = next((e for e in above if e.tag in BLOCK or e.tag in ("td", "th")), root)
                heading = any(e.tag in HEADINGS for e in above)
                if heading or not any(e.tag == "header" for e in above):
                    blocks.append((holder, text, heading))
                    sizes.append((holder, len(text), min(linked[0], len(text)), heading))
        read = None
        linked[0] = 0

    def close(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= e.tag == "a"
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            if not stack[-1].noise:
                add(page[at:mark])
                if links:
                    linked[0] += mark - at
            at = mark
            continue
        found = TOKEN.match(page, at)
        if found is None:
            if not stack[-1].noise:
                add("<")
            at += 1
            continue
        at = found.end()
        ending, starting = found.group(1), found.group(2)
        if ending:
            tag = ending.lower()
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if tag in BLOCK:
                flush()
            if k:
                # An end tag of a phrase does not close the blocks around it.
                if tag in BLOCK or tag in ("td", "th") or not any(e.tag in BLOCK for e in stack[k + 1 :]):
                    close(k)
            continue
        if not starting:
            continue
        tag = starting.lower()
        raw = found.group(3)
        if tag in ENDS:
            if not raw.endswith("/") or tag not in ("svg", "math"):
                end = ENDS[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
        if tag in ("br", "td", "th") and run:
            run.append(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in SCOPES), 0)
            if k and stack[k].tag == "p":
                close(k)
        if tag in CLOSES:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in CLOSES[tag] or stack[k].tag in SCOPES), 0)
            if k and stack[k].tag in CLOSES[tag]:
                close(k)
        if tag == "html" or (tag == "body" and any(e.tag == "body" for e in stack)):
            continue
        attributes = {}
        if raw and not raw.isspace():
            for m in ATTRIBUTE.finditer(raw):
                attributes.setdefault((m[1] or m[5]).lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        parent = stack[-1]
        name = generalised(tag, attributes) if attributes else tag
        e = Element(tag, f"{parent.path}>{name}" if parent.path else name, parent, parent.noise or noisy(tag, attributes, parent.inside), len(elements))
        if not e.noise and tag in WRAPPERS and (tag == "form" or attributes and marked(attributes)):
            e.own, e.soft = True, e
        e.names = names_of(attributes) if attributes else ""
        e.inside = parent.inside or tag in ("article", "main") or bool(attributes) and not CONTENT.isdisjoint(words_of(attributes))
        if len(stack) < DEPTH:
            elements.append(e)
            stack.append(e)
            links += tag == "a"
    flush()
    weigh(elements, sizes)
    if any(holder.soft for holder, *_ in sizes):
        relieve(elements, sizes, blocks)
        blocks = [b for b in blocks if b[0].soft is None]
    return elements, blocks


def value(e: Element) -> float:
    return e.score * (1 - e.links / e.text if e.text else 0) * (2 if e.tag in ("article", "main") else 1)


def best(elements: list[Element]) -> Element | None:
    """The container with the best score, widened while its parent adds only headings or long paragraphs."""
    top, most = None, 0.0
    for e in elements:
        if not e.noise and e.score and (worth := value(e)) > most:
            top, most = e, worth
    return widened(top) if top else None


def continued(top: Element, up: Element) -> bool:
    """What ``up`` adds to ``top`` is a part of the text: within content, mostly long paragraphs, and not little beside it."""
    more = up.text - up.headings - top.text + top.headings
    return up.inside and top.tag not in ("article", "main") and 4 * more >= top.text and 5 * (up.long - top.long) >= 4 * more > 0


def widened(top: Element) -> Element:
    while top.parent and top.parent.parent and top.parent.tag != "body":
        up = top.parent
        if continued(top, up):
            top = up
            continue
        if up.text - up.headings > top.text - top.headings or (up.headings == top.headings and up.tag not in ("article", "main")):
            break
        top = up
    return top


def vote(page: str | None) -> str | None:
    top = best(parse(page)[0]) if page else None
    return top.path if top else None


def text_in(holders: set[int], blocks: list[tuple[Element, str, bool]]) -> str:
    out = []
    for holder, text, _ in blocks:
        e: Element | None = holder
        while e is not None and e.order not in holders:
            e = e.parent
        if e is not None:
            out.append(text)
    return "\n".join(out)


def ranked(elements: list[Element], paths: list[str], votes: list[int] | None) -> list[str]:
    """``paths``, best container on this page first; a container counts for itself and for what it widens to."""
    worth = dict.fromkeys(paths, 0.0)
    for e in elements:
        if not e.noise and e.score:
            for path in {e.path, widened(e).path} & worth.keys():
                worth[path] = max(worth[path], value(e))
    for k, path in enumerate(paths):  # what has more votes and holds the better container is no worse
        worth[path] = max([worth[path], *(worth[p] for p in paths[k + 1 :] if p.startswith(f"{path}>"))])
    agreed = [p for p, n in zip(paths, votes, strict=True) if n > 1] if votes else []
    if agreed:
        lead = max(agreed, key=lambda p: worth[p])
        odds = votes[paths.index(lead)]
        for path, n in zip(paths, votes, strict=True):
            if n == 1:
                worth[path] /= odds
    return sorted(paths, key=lambda p: -worth[p])  # stable: more votes first


def extract(page: str | None, paths: list[str], votes: list[int] | None = None) -> tuple[str, str]:
    """(text, path) of a page, by the best of ``paths`` (most votes first) that holds text, else by its own best container."""
    if not page:
        return "", ""
    elements, blocks = parse(page)
    by_path: dict[str, list[Element]] = {}
    for e in elements:
        if not e.noise:
            by_path.setdefault(e.path, []).append(e)
    held = [k for k, p in enumerate(paths) if p in by_path]
    for path in ranked(elements, [paths[k] for k in held], [votes[k] for k in held] if votes else None):
        if (text := text_in({e.order for e in by_path[path]}, blocks)):
            return text, path
    top = best(elements)
    if top is None:
        return text_in({0}, blocks), ""
    return text_in({top.order}, blocks), top.path


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def votes(html: Column) -> Column:
    return arrow_udf(lambda pages: pa.array([vote(p) for p in pages.to_pylist()], pa.string()), "string")(html)


def winners(pages: DataFrame) -> DataFrame:
    """host, paths, votes: the winning paths of each host, most votes first."""
    counted = written(
        pages.select(host(F.col("url")).alias("host"), votes(F.col("html")).alias("path"))
        .where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    )
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    kept = counted.join(totals, "host").where(F.col("n") >= LEAST_SHARE * F.col("total"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    given = F.transform("ranked.n", lambda n: -n).alias("votes")
    return kept.groupBy("host").agg(order.alias("ranked")).select("host", F.col("ranked.path").alias("paths"), given)


def main_texts(pages: DataFrame) -> DataFrame:
    """Every page: page_id, url, text, n_chars, path."""

    def run(htmls: pa.Array, paths: pa.Array, given: pa.Array) -> pa.Array:
        rows = zip(htmls.to_pylist(), paths.to_pylist(), given.to_pylist(), strict=True)
        found = [extract(h, p or [], n) for h, p, n in rows]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["text", "path"])

    won = written(winners(pages))
    read = arrow_udf(run, "struct<text: string, path: string>")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(won, "host", "left")
    return rows.select("page_id", "url", read("html", "paths", "votes").alias("found")).select(
        "page_id", "url", F.col("found.text").alias("text"), F.length("found.text").cast("long").alias("n_chars"), F.col("found.path").alias("path")
    )

"""Main text of web pages by site template removal.

Every element's subtree is hashed from its leaves up, normalised: digits are one digit, link targets and labels are
left out, and like siblings in a row are one. Spark counts, for each host, the pages that have each hash; subtrees
that recur across pages are the host's template and are deleted.

Elements that a page itself names as no article text (navigation, footers, adverts, comments, by tag, class, id or
role) go on every page. They, and lists of links, are known by their shape alone, since their words change from page
to page; they are template on MIN_PAGES pages. All others are known by shape and words, and are template where they
stand beside MIN_BODIES different texts: the page's blocks outside the element tell these apart, so that an article
that a site shows at several addresses stays. Where articles hold half of a page's text or more, what stands outside
them is known by its shape as well, which finds parts without a telling name whose words change. Articles quote and repeat passages as well (one line stands in two fifths of
some hosts' articles), so inside an article, or where a page has none, they have to be on MIN_SHARE of the host's pages.

A host of fewer than MIN_PAGES pages has no counts to go by. There the names decide, and articles are preferred to
what stands outside them if they hold most of what is left.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import stored
from netweave.operators.components import salted_join

#: Pages of a host from which its counts decide and named subtrees are template; different texts beside any other subtree of a template.
MIN_PAGES, MIN_BODIES = 3, 3
#: Share of a host's pages that also have to have it where it may be an article's own.
MIN_SHARE = 0.5
#: What the lowest bits of a subtree's key say of it: named or a list of links; outside its page's articles; so, by its shape alone; perhaps an article's.
BY_SHAPE, BESIDE, OUTLINE, PERHAPS = 0, 1, 2, 3
#: Template hashes up to this number are broadcast (16 bytes each); more are joined to the pages that have them.
BROADCAST_HASHES = 1_000_000
#: Characters of link text to all text from which a subtree is a list of links.
LINK_SHARE = 0.5

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var br wbr img".split())
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPES = frozenset("ul ol table dl select body article main section div nav aside footer header".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BODIES = frozenset(("html", "body", "article", "main"))
#: Elements that show no text of an article, that hold controls, and that are named by their tag.
DROPPED = frozenset("head script style noscript template form iframe object svg canvas button select textarea dialog menu title".split())
CONTROLS = frozenset("button input select textarea".split())
NAMED = frozenset("nav footer aside".split())
#: Words of class, id and role: those that are never article text, and those that an article's own parts have too.
NEVER = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|gdpr|menu|modal|nav|navbar|navigation|newsletter|popup|promo\w*|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar)(?:$|[\s_-])", re.I)
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:banner|footer|header|masthead|notice|related|skip|widget)(?:$|[\s_-])", re.I)
_DIGITS = re.compile(r"[0-9]+")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {tag: re.compile(f"</{tag}[^>]*>", re.I) for tag in RAW}


@dataclass(slots=True)
class Node:
    tag: str
    start: int
    parent: int
    names: str
    drop: bool  # shows no text
    named: bool  # is no article text by its name
    article: bool  # is, or is in, an article or main element
    end: int = -1
    text: int = 0
    links: int = 0
    controls: int = 0
    shape: int = 0
    content: int = 0
    shapes: list[int] = field(default_factory=list)
    contents: list[int] = field(default_factory=list)


@dataclass
class Page:
    """A parsed page: nodes in source order, and events (node, begin, end) of its texts, (-1, 0, 0) between blocks, (-2, 0, 0) at line breaks."""

    source: str
    nodes: list[Node] = field(default_factory=list)
    events: list[tuple[int, int, int]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page(source, [Node("", 0, -1, "", False, False, False)])
    nodes, events, stack, open_tags = page.nodes, page.events, [0], Counter()

    def text(begin: int, end: int) -> None:
        if begin < end:
            own = nodes[stack[-1]]
            events.append((stack[-1], begin, end))
            own.text += end - begin
            if not own.drop and own.tag != "a":
                words = " ".join(source[begin:end].split())
                if words:
                    own.contents.append(xxhash.xxh64_intdigest(_DIGITS.sub("0", words)))

    def close(depth: int, at: int) -> None:
        while len(stack) > depth:
            done = nodes[stack.pop()]
            open_tags[done.tag] -= 1
            done.end = at
            done.shape = xxhash.xxh64_intdigest(f"{done.tag} {done.names} {done.shapes}")
            done.content = xxhash.xxh64_intdigest(f"{done.shape} {done.contents}")
            done.shapes = done.contents = []
            if done.tag == "a":
                done.links = done.text
            if done.parent >= 0:
                up = nodes[done.parent]
                up.text += done.text
                up.links += done.links
                up.controls += done.controls
                if not up.shapes or up.shapes[-1] != done.shape:
                    up.shapes.append(done.shape)
                up.contents.append(done.content)

    def close_last(tag: str, at: int) -> None:
        if open_tags[tag] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close(depth, at)
                    break

    def close_implied(tag: str, at: int) -> None:
        if open_tags[tag] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close(depth, at)
                    break
                if nodes[stack[depth]].tag in SCOPES:
                    break

    at, place = 0, _TAG.search(source)
    while place:
        text(at, place.start())
        at = place.end()
        tag = (place[2] or "").lower()
        if tag:
            if tag not in INLINE:
                events.append((-1, 0, 0))
            elif tag in ("br", "wbr"):
                events.append((-2, 0, 0))
            if place[1]:
                close_last(tag, at)
            else:
                for own in CLOSES.get(tag, ("p",) if tag in CLOSE_P else ()):
                    close_implied(own, place.start())
                if tag in CONTROLS:
                    nodes[stack[-1]].controls += 1
                if tag not in VOID and not place[3].endswith("/"):
                    up = nodes[stack[-1]]
                    names = " ".join(a or b or c for a, b, c in _NAMES.findall(place[3])) if place[3] else ""
                    named = bool(tag in NAMED or (tag == "header" and not up.article) or (names and tag not in BODIES and (NEVER.search(names) or (not up.article and OUTSIDE.search(names)))) or (tag == "article" and up.article and names and NEVER.search(names)))
                    article = up.article or (tag in ("article", "main") and not up.named)
                    nodes.append(Node(tag, place.start(), stack[-1], _DIGITS.sub("0", " ".join(names.split())), up.drop or tag in DROPPED, named, article))
                    stack.append(len(nodes) - 1)
                    open_tags[tag] += 1
                    if tag in RAW:
                        end = _RAW_END[tag].search(source, at)
                        at = end.end() if end else len(source)
                        close(len(stack) - 1, at)
        place = _TAG.search(source, at)
    text(at, len(source))
    close(0, len(source))
    return page


def keys(page: Page) -> list[int | None]:
    """What each subtree is counted by, as signed numbers: the shape of named ones and lists of links; shape and words of others.

    None where it shows no text, or is the page itself.
    """
    articles, found = any(n.article for n in page.nodes), []
    for n in page.nodes:
        if n.drop or not n.text or not n.tag or n.tag in BODIES:
            found.append(None)
            continue
        if n.named or n.links >= LINK_SHARE * n.text:
            h = n.shape & ~3 | BY_SHAPE
        else:
            h = n.content & ~3 | (BESIDE if articles and not n.article else PERHAPS)
        found.append(_signed(h))
    return found


def _signed(h: int) -> int:
    h = h or 4
    return h - (1 << 64) if h >> 63 else h


def outlines(page: Page) -> list[int | None]:
    """The shape of each unnamed subtree that shows text beside the page's articles, where these hold half of its text or more."""
    nodes = page.nodes
    shown = [(nodes[k].article, end - begin) for k, begin, end in page.events if k >= 0 and not (nodes[k].drop or nodes[k].named)]
    inside = sum(n for article, n in shown if article)
    if not inside or 2 * inside < sum(n for _, n in shown):
        return [None] * len(nodes)
    around = [n.article for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        around[nodes[k].parent] |= around[k]
    return [None if a or n.drop or n.named or not n.text or not n.tag or n.tag in BODIES else _signed(n.shape & ~3 | OUTLINE) for n, a in zip(nodes, around, strict=True)]


def block_texts(page: Page, dropped: list[bool]) -> Iterator[tuple[int, str]]:
    """(place of the first character, text) of the page's blocks, without what is dropped."""
    parts, first = [], -1
    for node, begin, end in [*page.events, (-1, 0, 0)]:
        if node == -1:
            block = " ".join(entities.unescape("".join(parts)).split())
            if block:
                yield first, block
            parts, first = [], -1
        elif node == -2:
            parts.append(" ")
        elif not dropped[node]:
            parts.append(page.source[begin:end])
            first = begin if first < 0 else first


def spread(page: Page, dropped: list[bool]) -> list[bool]:
    """``dropped``, handed on to all that is inside."""
    for k, n in enumerate(page.nodes[1:], 1):
        dropped[k] |= dropped[n.parent]
    return dropped


def subtree_hashes(page: Page) -> list[tuple[int, int]]:
    """(hash, context) of the page and its subtrees, each once. A context is a sum of hashes of what stands outside; the page has hash 0, and, as named subtrees do, its own source as context."""
    own = xxhash.xxh64_intdigest(page.source) >> 1
    blocks = list(block_texts(page, spread(page, [n.drop or n.named for n in page.nodes])))
    places = [at for at, _ in blocks]
    total = [0, *accumulate(xxhash.xxh64_intdigest(text) for _, text in blocks)]
    found = {0: own}
    for n, h in chain(zip(page.nodes, keys(page), strict=True), zip(page.nodes, outlines(page), strict=True)):
        if h is None or h in found:
            continue
        if h & 3 == BY_SHAPE:
            found[h] = own
            continue
        beside = total[-1] - total[bisect_left(places, n.end)] + total[bisect_left(places, n.start)]
        if beside:
            found[h] = beside & (1 << 63) - 1
    return list(found.items())


def main_text(page: Page, template: frozenset[int] | set[int] = frozenset(), named: bool = False) -> str:
    """The page's blocks without those of the template, one line each, and, if ``named`` or without counts of the host, without those that are named."""
    counted = 0 in template
    if counted:
        dropped = [n.drop or (named and n.named) or h in template or o in template for n, h, o in zip(page.nodes, keys(page), outlines(page), strict=True)]
    else:
        parts = [n.article and bool(OUTSIDE.search(n.names)) and (n.links >= LINK_SHARE * max(n.text, 1) or n.controls > 0) and n.tag not in BODIES for n in page.nodes]
        dropped = [n.drop or n.named or part for n, part in zip(page.nodes, parts, strict=True)]
    dropped = spread(page, dropped)
    if not counted:
        inside = sum(e - b for k, b, e in page.events if k >= 0 and not dropped[k] and page.nodes[k].article)
        if 2 * inside >= sum(e - b for k, b, e in page.events if k >= 0 and not dropped[k]) and inside:
            dropped = [d or not n.article for d, n in zip(dropped, page.nodes, strict=True)]
    return "\n".join(text for _, text in block_texts(page, dropped))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def hashes(html_col: Column) -> Column:
    """array<struct(hash, context)>: a page's distinct subtree hashes."""

    @F.pandas_udf("array<struct<hash:long,context:long>>")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{"hash": a, "context": b} for a, b in subtree_hashes(parse(h))] if h else [])

    return found(html_col)


def templates(seen: DataFrame) -> DataFrame:
    """(host, hash) of the templates, from (host, hash, context) of all pages; hash 0 of hosts whose counts decide."""
    counted = seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    kind = F.col("hash").bitwiseAND(3)
    often = stored(counted.where(F.col("n") >= F.when(kind == BY_SHAPE, MIN_PAGES).otherwise(MIN_BODIES)))
    whole = often.where("hash = 0").select("host", F.col("n").alias("pages"))
    perhaps = salted_join(often.where(kind == PERHAPS), whole, "host").where(F.col("n") >= MIN_SHARE * F.col("pages"))
    return often.where(kind != PERHAPS).select("host", "hash").unionByName(perhaps.select("host", "hash"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null or empty html has the empty text; null urls share the empty host. Repeated rows count as one page and give
    a row each. Only page_id, url and html are read, whatever other columns are called; an empty table gives no rows.
    A page of any length or depth is parsed in time and memory in proportion. Pages are parsed twice, once for their
    hashes and once for their text. Counting is combined before its shuffles, by host, hash and context, so one large
    host spreads out; pages are only shuffled where templates are too many to broadcast.
    """
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    known = stored(templates(rows.select("host", F.explode(hashes(F.col("html"))).alias("h")).select("host", "h.hash", "h.context")))
    if known.count() <= BROADCAST_HASHES:
        sets: dict[str, set[int]] = {}
        for r in known.collect():
            sets.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast(sets)

        @F.pandas_udf("string")
        def cleaned(hosts: pd.Series, sources: pd.Series) -> pd.Series:
            own = shared.value
            return pd.Series([main_text(parse(s), own.get(h, frozenset()), True) if s else "" for h, s in zip(hosts, sources, strict=True)], dtype=object)

        done = rows.select("page_id", "url", cleaned("host", "html").alias("text"))
    else:
        done = _joined(rows, known)
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """As the broadcast way: each page gets the template hashes that it has itself, by joins."""
    page = F.xxhash64("page_id", "url", "html")

    @F.pandas_udf("string")
    def cleaned(own: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(parse(s), frozenset(x if x is not None else ()), True) if s else "" for x, s in zip(own, sources, strict=True)], dtype=object)

    exploded = rows.select(page.alias("key"), F.col("host"), F.explode(hashes(F.col("html"))).alias("h")).select("key", "host", "h.hash")
    marks = exploded.join(known, ["host", "hash"], "left_semi").groupBy("key").agg(F.collect_set("hash").alias("own"))
    return rows.withColumn("key", page).join(marks, "key", "left").select("page_id", "url", cleaned(F.col("own"), F.col("html")).alias("text"))

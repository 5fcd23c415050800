"""Page text: templates decide where a host has pages to count, names elsewhere; long and deep pages."""

import collections
import os
import re
import time

from netweave.llm import html, queries


def host(url):
    found = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def brute_force(pages):
    """Templates by a count of every host's pages, one at a time."""
    seen = collections.defaultdict(set)
    for _, url, source in pages:
        for h, context in html.subtree_hashes(html.parse(source)) if source else ():
            seen[host(url), h].add(context)
    known = collections.defaultdict(set)
    for (own, h), contexts in seen.items():
        least = html.MIN_PAGES if h & 3 == html.BY_SHAPE else html.MIN_BODIES
        if len(contexts) >= least and (h & 3 != html.PERHAPS or len(contexts) >= html.MIN_SHARE * len(seen[own, 0])):
            known[own].add(h)
    return known


def test_text_is_that_of_counts_by_host_and_needs_them(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    known = brute_force(pages)
    want = {i: html.main_text(html.parse(s), known[host(u)]) if s else "" for i, u, s in pages}
    found = {r.page_id: (r.text, r.n_chars) for r in queries.op7_html(spark, sf_dir).collect()}
    assert found == {i: (t, len(t)) for i, t in want.items()}
    large = [(i, s) for i, u, s in pages if s and 0 in known[host(u)]]
    assert large and all(html.main_text(html.parse(s), {0}) != want[i] for i, s in large)  # without the templates their menus stand
    assert all("<nav" not in s or not want[i].startswith(re.search(r"<nav.*?<a[^>]*>([^<]*)", s, re.S)[1]) for i, s in large)


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"http://h.example/{i}", s) for i, s in enumerate(rows)], "page_id long, url string, html string")


def test_an_articles_own_parts_stay(spark):
    body = "<nav><a href='/{0}'>menu {0}</a></nav><article><div class='entry-header'><h1>Title {1}</h1></div><p class='notice'>Own notice {1}</p><p>A line that many share.</p><p>{2}</p><div class='share'><a href='#'>Share</a></div></article><div class='x9'>Get our letter</div>"
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [body.format(k, w, f"{w} is what this page is about, at some length") for k, w in enumerate(words)]
    rows[2:] = [r.replace("<p>A line that many share.</p>", "") for r in rows[2:]]
    found = {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}
    for k, w in enumerate(words):
        line = "A line that many share.\n" if k < 2 else ""
        assert found[k] == f"Title {w}\nOwn notice {w}\n{line}{w} is what this page is about, at some length"


def test_an_article_at_many_addresses_stays(spark):
    rows = [f"<div class='top'><a href='/{k}'>a</a></div><main><p>The same article, word for word, on every page.</p><p>Its second paragraph.</p></main>" for k in range(8)]
    assert {r.text for r in html.extract(pages_of(spark, rows)).collect()} == {"The same article, word for word, on every page.\nIts second paragraph."}


def test_one_page_of_a_host(spark):
    teaser = "<div id=content><p>The story is here, and it is long enough to be the most of the page.</p></div><article>Teaser</article><aside>side</aside>"
    assert [r.text for r in html.extract(pages_of(spark, [teaser])).collect()] == ["The story is here, and it is long enough to be the most of the page.\nTeaser"]


def test_long_and_deep_pages():
    for source in ("<div>" * 30_000 + "x" + "</div>" * 30_000, "<b><i>" * 8000 + "</u>" * 8000 + "<p>x" * 4000, "<p>word " * 100_000, "<ul>" + "<li><a href=x>y</a>" * 50_000):
        began = time.process_time()
        page = html.parse(source)
        html.subtree_hashes(page)
        html.main_text(page)
        assert time.process_time() - began < 10


def test_named_parts_go_on_the_one_page_that_has_them(spark):
    article = "<article><p>{0} is what this page is about, at some length, and it goes on.</p></article>"
    rows = [article.format(w) for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    rows[3] += "<section id='comments'><p>Reader: nice post</p></section><div class='cookie-banner'>We use cookies</div>"
    assert [r.text for r in sorted(html.extract(pages_of(spark, rows)).collect(), key=lambda r: r.page_id)] == [re.sub("<.*?>", "", article.format(w)) for w in ("alpha", "beta", "gamma", "delta", "epsilon")]


def test_parts_without_names_fall_by_their_shape(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    body = "<div class='wrap'><article><p>{0} is what this page is about, at some length, and it goes on.</p></article><div class='q7'>Today {1} for you</div></div>"
    rows = [body.format(w, w[::-1]) for w in words] + ["<div class='wrap'><div class='q7'>A page without articles, of one part alone</div></div>"]
    found = {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}
    assert found == {k: f"{w} is what this page is about, at some length, and it goes on." for k, w in enumerate(words)} | {6: "A page without articles, of one part alone"}


def test_counts_find_what_names_would(spark, sf_dir, monkeypatch):
    """With every name unknown, counts of shapes and words give the same text on nearly all pages of hosts that have counts."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{larger}/pages.parquet").select("page_id", "url", "html").collect() if r.html]
    want = {i: html.main_text(html.parse(s)) for i, _, s in pages}
    for name, blind in (("NEVER", re.compile("(?!)")), ("OUTSIDE", re.compile("(?!)")), ("NAMED", frozenset())):
        monkeypatch.setattr(html, name, blind)
    known = brute_force(pages)
    same = [html.main_text(html.parse(s), known[host(u)]) == want[i] for i, u, s in pages if 0 in known[host(u)]]
    assert len(same) > 100 and sum(same) >= 0.95 * len(same), (sum(same), len(same))

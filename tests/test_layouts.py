import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from leadloom.functions import tokens
from leadloom.sources import layouts, serp

FILLER = "<p class='end'>" + "words and more words " * 70 + "</p>"


def found(engine, body, filler=FILLER):
    return serp.LAYOUTS[engine](serp.tree(f"<html><body>{body}{filler}</body></html>"))


@pytest.mark.parametrize(
    ("engine", "body", "rows"),
    [
        ("mojeek", "<ul><li><a class='x ob' href='https://a.org'>go</a><h2>A</h2><p>one</p><p class='s'>two</p></li></ul>", [("https://a.org", "A", "two")]),
        ("mojeek", "<div><a class='ob' href='https://a.org'>go</a><h3>B</h3><p class='result-desc'>d</p></div>", [("https://a.org", "B", "d")]),
        ("mojeek", "<a class='ob' href='https://a.org'>alone</a>", [("https://a.org", "alone", "")]),
        ("mojeek", "<a class='ob' href='https://www.mojeek.com/x'>own</a><div><h2><a href='https://b.org'>B</a></h2><p>s</p></div>", [("https://b.org", "B", "s")]),
        ("mojeek", "<a class='ob' href='/relative'>r</a>", []),
        ("duckduckgo", "<table><tr><td><a class='result-link' href=' https://a.org '>A</a></td></tr><tr><td class='result-snippet'>s</td></tr></table>", [("https://a.org", "A", "s")]),
        ("duckduckgo", "<div class='result results_links_deep'><h2 class='result__title'><a class='result__a' href='//r'>T</a></h2><a class='result__snippet'>s</a></div>" + "w " * 7000, [("//r", "T", "s")]),
        ("duckduckgo", "<div class='result'><a href='/no'>n</a><a href='http://c.org'>y</a></div>" + "w " * 7000, [("http://c.org", "", "")]),
        ("duckduckgo", "<div class='result'><a href='http://c.org'>y</a></div>", []),
        ("yahoo", "<li><div class='compTitle'><h3><a href='x/RU=a/RK'>T</a></h3></div><div class='compText'>s</div></li>", [("x/RU=a/RK", "T", "s")]),
        ("yahoo", "<li><h3><b><a href='x/RU=b/RK'>T</a></b></h3><p>q</p><span class='fc-2nd'>f</span></li>", [("x/RU=b/RK", "T", "f")]),
        ("yahoo", "<article><a href='x/RU=c/RK'>t</a><h3>H</h3><p>q</p></article>", [("x/RU=c/RK", "H", "q")]),
        ("bing", "<li class='b_algo'><a href='z'>deep</a><h2><a href='https://a.org'>A</a></h2><p>s</p></li>", [("https://a.org", "A", "s")]),
        ("bing", "<section><h2><a href='https://b.org'>B</a></h2><p>s</p></section><div><h2>no link</h2></div>", [("https://b.org", "B", "s")]),
    ],
)
def test_forms_of_each_layout(engine, body, rows):
    assert found(engine, body) == rows


@pytest.mark.parametrize(("engine", "mark"), [("duckduckgo", "Select all squares"), ("yahoo", "CAPTCHA"), ("bing", "captcha")])
def test_blocked_pages(engine, mark):
    body = "<li class='b_algo'><h2><a class='result-link' href='https://a.org/RU=x'>A</a></h2></li>"
    assert found(engine, body) and not found(engine, body + mark) and not found(engine, body, "")


def test_work_grows_with_the_page(monkeypatch):
    """Elements are looked at once for each selector, however deep they lie and whatever was left open."""
    seen = []
    fits = layouts.Page.fits
    monkeypatch.setattr(layouts.Page, "fits", staticmethod(lambda e, s: seen.append(1) or fits(e, s)))
    for markup in ("<h2>x", "<h2><a href='http://y.example'>x", "<div>x", "<a class='ob' href='http://x.example'>x"):
        counts = []
        for n in (1000, 4000):
            seen.clear()
            for layout in serp.LAYOUTS.values():
                layout(serp.tree(markup * n + "x" * 2000))
            counts.append(len(seen))
        assert counts[1] < 4.2 * counts[0] + 200 and counts[1] < 60 * 4000


def test_next_links():
    link = lambda html: serp.next_link(layouts.Page(serp.tree(html)))
    assert link("<a href='/1'>1</a><nav><a href='/2'> Next » </a></nav>") == "/2" and link("<a href='/2'>next</a>") == ""
    assert link("<div><a href='/1'>next</a></div><a rel='next' href='/3'>x</a>") == "/3" and link("<a class='big next'>no address</a>") == ""


class Flat(HTMLParser):
    """Visible text from the parser's events alone, without a tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def flat(html):
    parser = Flat()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.out).split()).lower()


def test_text_of_broken_pages(spark):
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div class='a>b'>", "</div>", "<li>", "<b>Bold", "</i>", " words &amp; more ", "<br>", "<script>var a = '<p>';</script>", "<style>p{}</style>", "<!-- x > y -->", "a < b", "<td>", "</table>", "&nbsp;", "<a href=x>Link</a>", "\n"]
    pages = ["".join(rng.choices(bits, k=rng.randrange(0, 40))) for _ in range(300)] + ["", "<p", "&", "<" * 50, "<div>" * 3000 + "deep"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], "page_id int, html string")
    got = {r.page_id: r.body for r in serp.page_texts(df).collect()}
    assert got == {**{i: flat(p) for i, p in enumerate(pages)}, len(pages): ""}
    by_pattern = {r.page_id: r.body for r in df.filter("html is not null").select("page_id", tokens.page_text(F.col("html")).alias("body")).collect()}
    differ = [i for i, p in enumerate(pages) if by_pattern[i] != got[i]]
    assert differ and all("<" in pages[i] for i in differ)  # patterns end a tag at the first >, and take a < b for one
    plain = [i for i, p in enumerate(pages) if not any(x in p for x in ("a>b", "a < b", "x > y", "<p>'", "<<"))]
    assert len([i for i in plain if i in differ]) < 0.05 * len(plain)


def test_feeds(spark):
    items = "<item><title>A &amp; B</title><link> https://a.org/ </link><description>&lt;b&gt;x &amp;amp; y&lt;/b&gt; z</description></item>"
    feeds = [f"<rss><channel>{items}</channel></rss>", f"﻿ \n<?xml version='1.0'?><rss><channel>{items * 2}</channel></rss>", f"<rss><channel>{items}", "<rss><channel/></rss>", "<p>no feed</p>", "", None, "<rss><channel><item><title>a & b</title></item></channel></rss>"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(feeds)], "i int, html string")
    got = {r.i: r["items"] for r in df.select("i", serp.feed_items(F.col("html")).alias("items")).collect()}
    row = ("https://a.org/", "A & B", "x & yz")
    assert [tuple(x) for x in got[0]] == [row] and [tuple(x) for x in got[1]] == [row] * 2 and all(got[i] is None for i in range(2, 8))
    pages = df.select(F.lit("bing").alias("engine"), F.col("i").cast("long").alias("query_idx"), F.lit("q").alias("query"), F.lit(1).alias("page_no"), "html", F.lit(200).alias("http_status"))
    assert [(r.query_idx, r.url, r.title) for r in serp.extract_results(pages).orderBy("query_idx", "position").collect()] == [(0, "https://a.org/", "A & B"), (1, "https://a.org/", "A & B"), (1, "https://a.org/", "A & B")]


def test_a_layout_by_rows_alone(spark):
    rows = [(0, "item", 0, 0, "all", "article", "hit"), (0, "link", 0, 0, "in", "a"), (0, "title", 0, 0, "in", "b"), (0, "snippet", 0, 0, "up", "section"), (0, "snippet", 0, 1, "in", "i")]
    before = dict(serp.LAYOUTS)
    try:
        serp.register_table("new", rows, layouts.Rules(http_forms=(0,)))
        pages = spark.createDataFrame([("new", 0, "q", 1, "<section><i>s</i><article class=hit><a href='https://a.org'>x</a><b>T</b></article><article class=hit><a href='/r'>x</a></article></section>", 200)], "engine string, query_idx long, query string, page_no int, html string, http_status int")
        assert [tuple(r)[5:8] for r in serp.extract_results(pages).collect()] == [("https://a.org", "T", "s")]
    finally:
        serp.LAYOUTS.clear()
        serp.LAYOUTS.update(before)
    with pytest.raises(ValueError):
        layouts.compiled([(0, "item", 0, 0, "all", "p"), (0, "title", 0, 0, "sideways")])(serp.tree("<p>x</p>"))

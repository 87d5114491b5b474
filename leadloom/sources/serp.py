"""Results of stored search pages. A page's markup is parsed once, in Arrow batches; what comes out are small rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import urls
from leadloom.functions.entities import decode_entities
from leadloom.operators.lookup import first_by
from leadloom.sources.layouts import TABLES, Page, Rules, Selector, compiled

#: Elements inside which an element lies at most; those below are siblings of the last one, so that no page makes a deep tree.
DEPTH = 256
#: What a start tag closes, if it is open inside the nearest of the elements named next: end tags that pages may leave out.
BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, {"td", "th", "table"}),
    "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), **{t: ({"p"}, {"td", "th", "table", "button"}) for t in BLOCK},
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(eq=False)
class Element:
    """An element of a page with what a layout looks at."""

    tag: str
    attributes: dict
    parent: Element | None = None
    children: list = field(default_factory=list)
    depth: int = 0
    found: dict = field(default_factory=dict)

    def walk(self) -> Iterator[Element]:
        left = [c for c in reversed(self.children) if isinstance(c, Element)]
        while left:
            e = left.pop()
            yield e
            left += [c for c in reversed(e.children) if isinstance(c, Element)]

    def text(self) -> str:
        """Its text, pieces stripped and joined, without scripts and styles."""
        out, left = [], self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c.strip())
            elif c.tag not in ("script", "style", "template"):
                left += c.children[::-1]
        return "".join(out)

    def has(self, tag: str = "", cls: str = "", attribute: str = "") -> bool:
        return (not tag or self.tag == tag) and (not cls or cls in (self.attributes.get("class") or "").split()) and (not attribute or attribute in self.attributes)

    def find(self, tag: str = "", cls: str = "", attribute: str = "") -> Element | None:
        key = (tag, cls, attribute)
        if key not in self.found:  # a box with many links is searched once, not once a link
            self.found[key] = next((e for e in self.walk() if e.has(tag, cls, attribute)), None)
        return self.found[key]

    def all(self, tag: str = "", cls: str = "", attribute: str = "") -> list[Element]:
        return [e for e in self.walk() if e.has(tag, cls, attribute)]

    def above(self, *tags: str) -> Element | None:
        """The nearest ancestor of the first of the tags that has one."""
        for tag in tags:
            at = self.parent
            while at is not None and at.tag != tag:
                at = at.parent
            if at is not None:
                return at
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})
        self.below = 0

    def handle_starttag(self, tag, attrs):
        closed, bounds = CLOSES.get(tag, ((), ()))
        e = self.at if closed else self.root
        while e.parent is not None and e.tag not in closed and e.tag not in bounds:
            e = e.parent
        if e.tag in closed and e.parent is not None:
            self.at, self.below = e.parent, 0
        e = Element(tag, dict(attrs), self.at, depth=self.at.depth + 1)
        self.at.children.append(e)
        if tag not in VOID:
            if e.depth < DEPTH:
                self.at = e
            else:
                self.below += 1

    def handle_endtag(self, tag):
        if self.below:
            self.below -= 1
            return
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _rss_layout(page: str) -> list[tuple]:
    from xml.etree import ElementTree

    body = page.lstrip("﻿").strip()
    if not body.startswith(("<?xml", "<rss")):
        return []
    try:
        items = ElementTree.fromstring(body).findall(".//item")
    except ElementTree.ParseError:
        return []
    part = lambda i, name: (i.findtext(name) or "").strip()
    return [(part(i, "link"), part(i, "title"), tree(i.findtext("description") or "").text()) for i in items]


#: What a link to the next page says, where no attribute does.
NEXT_TEXTS = ("next", "›", ">>", "next »", ">")


def next_link(page: Page) -> str:
    """The address of the next page as it is written, or an empty text."""
    links = page.matches(Selector(0, "", 0, 0, "all", "a", "", "href"))
    marked = lambda e: e.attributes.get("id") == "pg-next" or e.attributes.get("rel") == "next" or e.attributes.get("aria-label") == "Next" or e.has(cls="next")
    at = next((k for k in links if marked(page.elements[k])), None)
    if at is None:
        at = next((k for k in links if (page.above(k, "nav") or page.above(k, "div")) and page.text(k).lower() in NEXT_TEXTS), None)
    return "" if at is None else page.elements[at].attributes["href"] or ""


#: Layouts by engine: functions from a page's tree to (href, title, snippet) rows. Users add theirs with register() or register_table().
LAYOUTS: dict[str, Callable] = {engine: compiled(*table) for engine, table in TABLES.items()}
#: Engines whose pages may be feeds, which Spark's own XML reader takes apart; and feeds for the table function, from source text.
XML_FEEDS = {"bing"}
FEEDS: dict[str, Callable] = {"bing": _rss_layout}
FEED_SCHEMA = "channel struct<item: array<struct<link: string, title: string, description: string>>>, _broken string"


def register(engine: str, layout: Callable) -> None:
    """Adds a layout, or replaces one."""
    LAYOUTS[engine] = layout


def register_table(engine: str, selectors: Iterable[Selector | tuple], rules: Rules = Rules()) -> None:  # noqa: B008
    """Adds a layout that is a table of selectors, the rows of a DataFrame's collect() for one."""
    register(engine, compiled(selectors, rules))


def feed_items(html: Column) -> Column:
    """The items of an RSS feed (link, title, description without markup), or null for what is no feed, a broken one or one without items."""
    body = F.regexp_replace(html, "^[\\x{FEFF}\\s]+", "")
    feed = F.when(body.startswith("<?xml") | body.startswith("<rss"), F.from_xml(body, FEED_SCHEMA, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    said = lambda c: F.coalesce(c, F.lit(""))
    bare = lambda c: F.trim(decode_entities(F.regexp_replace(F.regexp_replace(said(c), "(?is)<(script|style|template)\\b.*?</\\1\\s*>|<!--.*?-->", ""), "(?s)\\s*<[a-zA-Z/!?][^>]*>\\s*", "")))
    items = F.transform(feed["channel"]["item"], lambda i: F.struct(F.trim(said(i["link"])).alias("href"), F.trim(said(i["title"])).alias("title"), bare(i["description"]).alias("snippet")))
    return F.when(F.size(items) > 0, items)


_ROWS = "engine string, query_idx long, query string, page_no int, position int, href string, title string, snippet string, next_url string, is_feed boolean"


def parse_pages(pages: DataFrame, layouts: dict[str, Callable] | None = None) -> DataFrame:
    """engine, query_idx, query, page_no, html, http_status -> rows as they are written in the pages, not unwrapped or filtered yet.

    layouts: instead of those registered. Feeds are taken apart before any Python; the source of a page that has feed items
    doesn't reach it.
    """
    layouts = dict(LAYOUTS if layouts is None else layouts)
    feeds = {k: f for k, f in FEEDS.items() if k not in XML_FEEDS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.engine not in layouts:
                    continue
                found, link = [(i["href"], i["title"], i["snippet"]) for i in r.items] if r.items is not None else [], ""
                if not found and r.html:
                    found = feeds[r.engine](r.html) if r.engine in feeds else []
                rows = found
                if not found and r.html:
                    root = tree(r.html)
                    page, layout = Page(root), layouts[r.engine]
                    rows, link = layout(page if getattr(layout, "indexed", False) else root), next_link(page)
                out += [(r.engine, r.query_idx, r.query, r.page_no, k, *row, link, bool(found)) for k, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROWS.split(", ")])

    asked = pages.filter("http_status = 200").withColumn("items", F.when(F.col("engine").isin(sorted(XML_FEEDS)), feed_items(F.col("html"))))
    source = F.when(F.col("items").isNull(), F.col("html")).alias("html")
    return asked.select("engine", "query_idx", "query", "page_no", source, "items").mapInPandas(run, _ROWS)


def page_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, body: a page's visible text by its tree, pieces joined by blanks, in lower case, as a reader of the tree (not of tags) sees it."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "body": [Page(tree(h)).spaced_text().lower() if h else "" for h in batch["html"]]})

    return pages.select(key, "html").mapInPandas(run, f"`{key}` {kind}, body string")


def extract_results(pages: DataFrame, layouts: dict[str, Callable] | None = None) -> DataFrame:
    """Results of stored search pages: addresses unwrapped, own-site links and feeds' foreign results gone, one a domain (or address) and page."""
    rows, href = parse_pages(pages, layouts), F.col("href")
    url = F.when(F.col("engine") == "yahoo", urls.unwrap_ru(href)).when(F.col("engine") == "duckduckgo", urls.unwrap_uddg(href)).when((F.col("engine") == "bing") & ~F.col("is_feed"), urls.unwrap_u(href)).otherwise(href)
    title = F.when(F.col("engine") == "yahoo", urls.clean_title(F.col("title"))).otherwise(F.col("title"))
    out = rows.withColumns({"url": url, "title": title}).filter("startswith(url, 'http') and not (engine = 'bing' and contains(url, 'bing.com'))")
    out = out.filter(~F.col("is_feed") | urls.is_english(F.col("title"), F.col("snippet"))).withColumn("domain", urls.base_domain(F.col("url")))
    key = F.when(F.col("engine") == "duckduckgo", F.col("url")).when(F.col("engine") == "bing", F.col("position").cast("string")).otherwise(F.col("domain"))
    out = first_by(out.withColumn("_key", key), ["engine", "query_idx", "page_no", "_key"], [F.col("position")])
    return out.select("engine", "query_idx", "query", "page_no", "position", "url", "title", "snippet", "domain", "next_url")


def result_rows():
    """A table function (engine, html) -> rows of one page, to be used in SQL once it is registered: spark.udtf.register(name, result_rows())."""
    from pyspark.sql.functions import udtf

    layouts, feeds = dict(LAYOUTS), dict(FEEDS)

    @udtf(returnType="position int, href string, title string, snippet string")
    class Rows:
        def eval(self, engine: str, html: str):
            if html and engine in layouts:
                found = feeds[engine](html) if engine in feeds else []
                for k, row in enumerate(found or layouts[engine](tree(html))):
                    yield (k, *row)

    return Rows

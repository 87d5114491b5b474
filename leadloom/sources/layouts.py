"""Layouts of result pages as tables of selectors. A page is indexed in one pass over its tree; selectors are look-ups in that index."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable
from typing import NamedTuple

UNSEEN = ("script", "style", "template")


class Selector(NamedTuple):
    """A step of a way through a page; a layout is a table of these.

    form: forms are tried in order until one gives rows. part: item (what there is a row for), needs (an item counts if one of
    these ways leads somewhere), box, link (has the address; else the item), title, snippet. choice: ways are tried in order; of
    items the first way that gives any. step: in order.
    move: all (matching elements of the page), in (the first inside), up (the nearest ancestor of the tag), parent (if it
    matches), next (the next sibling of the tag), item, box (go there).
    """

    form: int
    part: str
    choice: int
    step: int
    move: str
    tag: str = ""
    cls: str = ""
    attribute: str = ""
    value: str = ""  # that the attribute holds, or with ^ before it starts with


class Rules(NamedTuple):
    """When a page has no results at all, and which rows count. thin: pages with less text need an element of class `sign`."""

    least_text: int = 0
    banned: tuple[str, ...] = ()
    thin: int = 0
    sign: str = ""
    own_site: str = ""
    http_forms: tuple[int, ...] = ()


class Page:
    """Elements in document order with what lies inside each, and the pieces of text."""

    def __init__(self, root):
        self.elements, self.ends, self.pieces = [], [], []
        self.place, self.text_spans = {}, []
        left = [(root, 0)]
        while left:
            e, child = left.pop()
            if child == 0:
                self.place[id(e)] = len(self.elements)
                self.elements.append(e)
                self.ends.append(0)
                self.text_spans.append([len(self.pieces), 0])
            for k in range(child, len(e.children)):
                c = e.children[k]
                if isinstance(c, str):
                    if e.tag not in UNSEEN:
                        self.pieces.append(c.strip())
                else:
                    left += [(e, k + 1), (c, 0)]
                    break
            else:
                at = self.place[id(e)]
                self.ends[at], self.text_spans[at][1] = len(self.elements), len(self.pieces)
        self._matches: dict[tuple, list[int]] = {}
        self._above: dict[str, list[int]] = {}
        self._next: dict[str, dict[int, int]] = {}
        self.by_tag = defaultdict(list)
        for k, e in enumerate(self.elements):
            self.by_tag[e.tag].append(k)

    def text(self, at: int = 0) -> str:
        a, b = self.text_spans[at]
        return "".join(self.pieces[a:b])

    def spaced_text(self) -> str:
        """All visible text, pieces joined by blanks, blanks squeezed."""
        return " ".join(" ".join(self.pieces).split())

    @staticmethod
    def fits(e, s: Selector) -> bool:
        if s.tag and e.tag != s.tag or s.cls and s.cls not in (e.attributes.get("class") or "").split():
            return False
        if not s.attribute:
            return True
        value = e.attributes.get(s.attribute, None)
        if s.attribute not in e.attributes:
            return False
        return (value or "").startswith(s.value[1:]) if s.value.startswith("^") else s.value in (value or "")

    def matches(self, s: Selector) -> list[int]:
        """Places of all elements that match, worked out once for each selector."""
        key = s[5:]
        if key not in self._matches:
            among = self.by_tag[s.tag] if s.tag else range(1, len(self.elements))
            self._matches[key] = [k for k in among if k and self.fits(self.elements[k], s)]
        return self._matches[key]

    def above(self, at: int, tag: str) -> int | None:
        if tag not in self._above:
            near = [-1] * len(self.elements)
            for k in range(1, len(self.elements)):
                p = self.place[id(self.elements[k].parent)]
                near[k] = p if self.elements[p].tag == tag else near[p]
            self._above[tag] = near
        found = self._above[tag][at]
        return None if found < 0 else found

    def next(self, at: int, tag: str) -> int | None:
        if tag not in self._next:
            follows, last = {}, {}
            for k in self.by_tag[tag]:
                parent = id(self.elements[k].parent)
                if parent in last:
                    follows[last[parent]] = k
                last[parent] = k
            self._next[tag] = follows
        return self._next[tag].get(at)

    def step(self, at: int, s: Selector) -> int | None:
        if s.move == "in":
            found = self.matches(s)
            k = bisect_left(found, at + 1)
            return found[k] if k < len(found) and found[k] < self.ends[at] else None
        if s.move == "up":
            return self.above(at, s.tag)
        if s.move == "next":
            return self.next(at, s.tag)
        if s.move == "parent":
            p = self.elements[at].parent
            return self.place[id(p)] if p is not None and self.fits(p, s) else None
        raise ValueError(f"no move {s.move}")


def compiled(selectors: Iterable[Selector | tuple], rules: Rules = Rules()) -> Callable:  # noqa: B008
    """A layout: a function from a page, its tree or its index, to its rows (address, title, snippet)."""
    ways: dict[int, dict[str, dict[int, list[Selector]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for s in sorted(Selector(*s) for s in selectors):
        ways[s.form][s.part][s.choice].append(s)

    def follow(page: Page, way: list[Selector], item: int, box: int | None) -> int | None:
        at: int | None = item
        for s in way:
            at = item if s.move == "item" else box if s.move == "box" else page.step(at, s)
            if at is None:
                return None
        return at

    def first(page: Page, choices: dict[int, list[Selector]], item: int, box: int | None) -> int | None:
        return next((at for k in sorted(choices) if (at := follow(page, choices[k], item, box)) is not None), None)

    def items(page: Page, form: dict) -> list[int]:
        for k in sorted(form["item"]):
            start, *rest = form["item"][k]
            found = [follow(page, rest, at, None) for at in page.matches(start) if not form["needs"] or first(page, form["needs"], at, None) is not None]
            if found := [at for at in found if at is not None]:
                return found
        return []

    def rows(tree) -> list[tuple[str, str, str]]:
        page = tree if isinstance(tree, Page) else Page(tree)
        text = page.text()
        low = text.lower()
        if len(text) < rules.least_text or any(b in low for b in rules.banned):
            return []
        if len(text) < rules.thin and not page.matches(Selector(0, "", 0, 0, "all", "", rules.sign)):
            return []
        said = lambda at: "" if at is None else page.text(at)
        for number in sorted(ways):
            form, out = ways[number], []
            for item in items(page, form):
                box = first(page, form["box"], item, None)
                link = first(page, form["link"], item, box) if form["link"] else item
                if link is not None:
                    href = (page.elements[link].attributes.get("href") or "").strip()
                    out.append((href, said(first(page, form["title"], item, box)), said(first(page, form["snippet"], item, box))))
            if number in rules.http_forms:
                out = [r for r in out if r[0].startswith("http") and not (rules.own_site and rules.own_site in r[0])]
            if out:
                return out
        return []

    rows.indexed = True
    return rows


def way(form: int, part: str, choice: int, *steps: str) -> list[Selector]:
    """The rows of one way, each step written `move tag .class [attribute value]`, as in `in a .title` or `all a [href /RU=]`."""
    out = []
    for k, step in enumerate(steps):
        head, _, rest = step.partition("[")
        move, *names = head.split()
        attribute, _, value = rest.rstrip("]").partition(" ")
        out.append(Selector(form, part, choice, k, move, next((n for n in names if n[0] != "."), ""), next((n[1:] for n in names if n[0] == "."), ""), attribute, value))
    return out


def _ways(form: int, **parts: list[tuple[str, ...]]) -> list[Selector]:
    return [s for part, choices in parts.items() for k, steps in enumerate(choices) for s in way(form, part, k, *steps)]


_BOX = [("up li",), ("up div",)]
#: Selectors and rules of the four layouts.
TABLES: dict[str, tuple[list[Selector], Rules]] = {
    "mojeek": (
        _ways(
            0, item=[("all a .ob [href]",)], box=_BOX, title=[("box", "in h2"), ("box", "in h3"), ("box", "in a .title"), ("item",)],
            snippet=[("box", "in p .s"), ("box", "in p .result-desc"), ("box", "in p")],
        )
        + _ways(1, item=[("all h2",)], box=_BOX, link=[("in a [href]",)], title=[("item",)], snippet=[("box", "in p")]),
        Rules(300, own_site="mojeek.com", http_forms=(0, 1)),
    ),
    "duckduckgo": (
        _ways(0, item=[("all a .result-link",)], title=[("item",)], snippet=[("up tr", "next tr", "in td .result-snippet")])
        + _ways(
            1, item=[("all div .results_links_deep [class result]",), ("all div .web-result [class result]",), ("all div .result",), ("all article",)],
            link=[("in a .result__a [href]",), ("in h2", "in a [href]"), ("in a [href ^http]",)], title=[("in h2 .result__title",), ("in h2",)], snippet=[("in a .result__snippet",), ("in .result__snippet",)],
        ),
        Rules(1000, ("captcha", "select all squares"), 13_000, "result-link", http_forms=(0,)),
    ),
    "yahoo": (
        _ways(
            0, item=[("all a [href /RU=]",)], needs=[("parent div .compTitle",), ("parent h3", "parent div .compTitle")], box=_BOX, title=[("up h3",), ("item",)],
            snippet=[("box", "in div .compText"), ("box", "in p .lh-16"), ("box", "in span .fc-2nd"), ("box", "in p")],
        )
        + _ways(
            1, item=[("all a [href /RU=]",)], needs=[("up h3",)], box=_BOX, title=[("up h3",), ("item",)],
            snippet=[("box", "in div .compText"), ("box", "in p .lh-16"), ("box", "in span .fc-2nd"), ("box", "in p")],
        )
        + _ways(2, item=[("all a [href /RU=]",)], box=[*_BOX, ("up article",)], title=[("box", "in h3"), ("item",)], snippet=[("box", "in p")]),
        Rules(300, ("captcha",)),
    ),
    "bing": (
        _ways(0, item=[("all li .b_algo",)], link=[("in h2", "in a [href]"), ("in a [href]",)], title=[("in h2",), ("in h3",)], snippet=[("in p",)])
        + _ways(1, item=[("all h2", "parent")], needs=[("in a [href]",)], link=[("in h2", "in a [href]"), ("in a [href]",)], title=[("in h2",), ("in h3",)], snippet=[("in p",)]),
        Rules(300, ("captcha",)),
    ),
}

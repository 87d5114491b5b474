import time

import pytest

from leadloom.sources import serp


@pytest.mark.parametrize("tag", ["p", "li", "div", "b", "td", "a class='ob' href='http://x.example'", "dd", "h2", "/div", "option"])
def test_many_unclosed_tags(tag):
    start = time.monotonic()
    page = serp.tree(f"<{tag}>x" * 100_000)
    for layout in serp.LAYOUTS.values():
        layout(page)
    assert page.text() == "x" * 100_000 and time.monotonic() - start < 30


def test_implied_end_tags():
    page = serp.tree("<ul><li>one<li>two <ul><li>inner</ul><li>three</ul><table><tr><td>a<td>b<tr><td>c</table><p>x<p>y<div>z</div><dl><dt>k<dd>v<dt>l</dl>")
    assert [e.text() for e in page.all("li")] == ["one", "twoinner", "inner", "three"] and [e.text() for e in page.all("tr")] == ["ab", "c"]
    assert [e.text() for e in page.all("p")] == ["x", "y"] and page.find("div").parent.tag == "" and [e.text() for e in page.find("dl").children] == ["k", "v", "l"]


def test_results_of_a_page_without_end_tags(spark):
    rows = "".join(f"<li class='b_algo'><h2><a href='https://firm{k}.example/'>Firm {k}</a></h2><p>what it does" for k in range(3))
    html = f"<html><body><ol>{rows}</ol><p>{'text ' * 100}" + "<div>" * 5_000
    pages = spark.createDataFrame([("bing", 0, "q", 1, html, 200), ("bing", 0, "q", 2, "<p>" * 50_000, 200)], "engine string, query_idx long, query string, page_no int, html string, http_status int")
    got = serp.extract_results(pages).orderBy("position").collect()
    assert [(r.url, r.title, r.snippet) for r in got] == [(f"https://firm{k}.example/", f"Firm {k}", "what it does") for k in range(3)]

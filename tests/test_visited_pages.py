"""Streams work at pages that targets visit alone, with all cores, and give what they gave of all pages."""

import pytest
from pyspark.sql import functions as F

from leadloom.config import LeadConfig
from leadloom.plans import queries
from leadloom.streaming import sites

CONFIG = LeadConfig()
PAGES = [(f"https://{'www.' * (n % 2)}a{n}.com{path}", n, path) for n in range(6) for path in ("/", "/contact", "/blog/1", "/blog/2?x=1")]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, url, f"<title>Firm {n} Ltd</title><p>mail info@a{n}.com, roofing{path}</p>", "rendered" if n == 5 else "static", 404 if n == 4 else 200) for k, (url, n, path) in enumerate(PAGES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, render_mode string, status int")


@pytest.fixture(scope="module")
def plan(spark):
    targets = spark.createDataFrame([(f"a{n}.com", f"https://a{n}.com/", "roofing") for n in range(1, 9)], "key string, website string, search_query string")
    return sites.visit_table(targets, CONFIG)


def test_visited(pages, plan):
    got = {r.url for r in sites.visited(pages, plan).collect()}
    assert got == {url for url, n, path in PAGES if n > 0 and not path.startswith("/blog")}


def test_visits_of_visited_pages_are_all_visits(pages, plan, monkeypatch):
    rows = lambda: sorted(map(repr, sites.visits(pages, plan, CONFIG).collect()))
    few = rows()
    monkeypatch.setattr(sites, "SENT_VISITS", 0)
    assert sites.visited(pages, plan) is pages
    assert few == rows() and len(few) == 8


def test_batches_of_many_files(spark, pages, tmp_path):
    many = pages.crossJoin(spark.range(50)).withColumn("page_id", F.col("page_id") * 50 + F.col("id")).drop("id")
    seen = []
    put = lambda rows, n: seen.append((rows.count(), rows.select(F.input_file_name()).distinct().count()))
    queries._page_arrivals(spark, many, "many", 3).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for n, _ in seen) == 1200
    assert all(files == spark.sparkContext.defaultParallelism for _, files in seen)

import time

from pyspark.sql import functions as F

from leadloom.plans import queries
from leadloom.sources import serp


def test_pages_stay_small(spark, tmp_path):
    n = 3000
    html = F.format_string("<title>T%d</title><p>S%d</p>", "id", "id")
    spark.range(n).select(F.col("id").alias("page_id"), F.format_string("https://h%d.org/x", "id").alias("url"), html.alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    pages = queries._result_pages(spark, str(tmp_path))
    assert pages.count() == n // 10 and pages.select("engine", "query_idx", "page_no").distinct().count() == n // 10
    found = serp.extract_results(pages).collect()
    assert {(r.url, r.title, r.snippet) for r in found} == {(f"https://h{i}.org/x", f"T{i}", f"S{i}") for i in range(n)} and len(found) == n
    assert max(r.position for r in found) == 9


def test_long_page_in_linear_time():
    rows = lambda n: "".join(f"<tr><td><a class='result-link' href='https://h{i}.org'>T{i}</a></td></tr><tr><td class='result-snippet'>S{i}</td></tr>" for i in range(n))
    page = serp.tree(f"<table>{rows(8000)}</table>" + "text " * 400)
    start = time.process_time()
    got = serp.LAYOUTS["duckduckgo"](page)
    assert got == [(f"https://h{i}.org", f"T{i}", f"S{i}") for i in range(8000)] and time.process_time() - start < 5

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.config import LeadConfig
from leadloom.operators.clean import clean_results
from leadloom.operators.enrich import enrich
from leadloom.sources import versions
from leadloom.streaming import incremental, sites
from leadloom.streaming.runs import RunTable

RAW = "engine string, query_idx long, query string, page_no int, position long, url string, title string, snippet string"
CONFIG = LeadConfig()


def test_upsert_equals_batch(spark, tmp_path):
    rows = [("mojeek" if i % 2 else "bing", 0, "roof", 1, i, f"https://s{i % 11}.org/{i}", "roof", "") for i in range(50)]
    raw = spark.createDataFrame(rows, RAW)
    raw.repartition(4, "position").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run has nothing to add
        incremental.upsert_stream(incremental.read_stream(spark, str(tmp_path / "in"), raw.schema, 1), str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG).awaitTermination()
    got = [tuple(r) for r in incremental.lead_table(spark, str(tmp_path / "out"), CONFIG).read().collect()]
    assert sorted(got, key=str) == sorted(map(tuple, clean_results(raw, CONFIG).collect()), key=str)


def test_dedupe_with_watermark(spark, tmp_path):
    raw = spark.createDataFrame([("bing", 0, "q", 1, i, f"https://s{i % 3}.org/", "t", "") for i in range(9)], RAW)
    raw.selectExpr("*", "timestamp'2024-01-01 00:00:00' as ts").write.parquet(str(tmp_path / "in"))
    stream = incremental.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = incremental.dedupe_stream(stream, CONFIG, "ts").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 3


def test_progress_versions(spark, tmp_path):
    """Runs are in order of their numbers, and one without its mark doesn't count."""
    path, rows = str(tmp_path / "runs"), lambda x: spark.createDataFrame([(x, "a")], "engine string, query string")
    for run in ("9", "10", "11"):
        incremental.save_progress(rows(run), path, run)
    versions.break_off(spark, f"{path}/run=11")
    assert incremental.load_progress(spark, path).first().engine == "10" == incremental.load_progress(spark, path, ["9", "10", "11"]).first().engine
    assert incremental.load_progress(spark, path, ["9"]).first().engine == "9" and incremental.load_progress(spark, path, ["11"]) is None
    for run in ("b", "a"):  # other names: by time
        incremental.save_progress(rows(run), str(tmp_path / "named"), run)
    os.utime(tmp_path / "named" / "run=b" / "_SUCCESS", (1, 1))
    assert versions.complete(spark, str(tmp_path / "named")) == ["b", "a"] and versions.complete(spark, str(tmp_path / "none")) == []


def test_progress(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert incremental.load_progress(spark, path, ["1"]) is None
    incremental.save_progress(spark.createDataFrame([("bing", "a")], "engine string, query string"), path, "1")
    done = incremental.load_progress(spark, path, ["2", "1"])
    todo = spark.createDataFrame([("bing", "a"), ("yahoo", "a")], "engine string, query string")
    assert [r.engine for r in incremental.pending(todo, done).collect()] == ["yahoo"] and incremental.pending(todo, None).count() == 2


def run_table(spark, path, fan=3):
    return RunTable(spark, path, StructType.fromDDL("k string, v long, batch long"), "k", [F.desc("batch")], fan=fan, buckets=2)


def test_runs_merge_and_are_done_again(spark, tmp_path):
    table = run_table(spark, str(tmp_path / "t"))
    assert table.batches() == 0 and table.read().count() == 0
    state, rows = {}, lambda n: [(f"k{(n * 5 + i) % 7}", n * 10 + i, n) for i in range(3 if n != 4 else 0)]
    for n in range(11):
        table.put(spark.createDataFrame(rows(n), "k string, v long, batch long"), n)
        state |= {k: v for k, v, _ in rows(n)}
    assert table.live(11) == [(0, 10), (0, 9), (2, 0)] and table.batches() == 11
    assert {r.k: r.v for r in table.read().collect()} == state
    assert {r.k for r in table.of(spark.createDataFrame([("k1",), ("k3",), ("none",)], "k string")).collect()} == {"k1", "k3"}
    # the last batch of a merge breaks off and is done again
    versions.break_off(spark, f"{table.path}/level=2/run=0")
    assert table.batches() == 8 and {r.k for r in table.read().collect()} <= set(state)
    table.put(spark.createDataFrame(rows(8), "k string, v long, batch long"), 8)
    assert table.batches() == 11 and {r.k: r.v for r in table.read().collect()} == state
    assert table.vacuum() == 9 + 3 - 0 and {r.k: r.v for r in table.read().collect()} == state


def test_a_better_engine_wins_later(spark, tmp_path):
    rows = [("bing", 0, "roof", 1, 0, "https://a.org/", "roof", ""), ("mojeek", 0, "roof", 1, 1, "https://a.org/x", "roof", ""), ("yahoo", 0, "roof", 1, 2, "https://b.org/", "roof", "")]
    mode = "append"
    for k, row in enumerate(rows):
        spark.createDataFrame([row], RAW).write.mode(mode).parquet(str(tmp_path / "in"))
        incremental.upsert_stream(incremental.read_stream(spark, str(tmp_path / "in"), StructType.fromDDL(RAW)), str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG).awaitTermination()
        got = {r.domain: r.search_engine for r in incremental.lead_table(spark, str(tmp_path / "out"), CONFIG).read().collect()}
        assert got == [{"a.org": "bing"}, {"a.org": "mojeek"}, {"a.org": "mojeek", "b.org": "yahoo"}][k]


PAGES = "url string, html string, render_mode string, status int, at timestamp"
TARGETS = "key string, name string, website string, phone string, category string, search_query string"
DAY = datetime(2024, 5, 1)


def site_rows(hour, *pages):
    return [(f"https://{site}.org{path}", html, mode, 200, DAY + timedelta(hours=hour)) for site, path, mode, html in pages]


def test_sites_in_any_order(spark, tmp_path):
    """Pages one by one, contact pages before home pages: the rows of enrich, early exit and second pass included."""
    targets = spark.createDataFrame([(s, s.upper(), f"https://{s}.org/", "", "c", "roofing leeds") for s in "abcd"], TARGETS)
    filler = "<title>Roofing Leeds</title>" + "roofing in leeds, contact us " * 3
    pages = site_rows(
        0, ("a", "/contact", "static", "jane@a.org"), ("a", "/about", "static", "bob@a.org 020 7946 0958"), ("a", "", "static", filler), ("b", "", "rendered", "x@b.org"),
        ("b", "/about", "rendered", "not@visited.org"), ("b", "", "static", "nothing"), ("c", "", "rendered", "y@c.org"), ("c", "/contact-us", "static", "+44 20 7946 1123"), ("d", "", "static", filler),
    )
    table = spark.createDataFrame(pages, PAGES)
    want = sorted(map(str, enrich(targets, table, CONFIG).collect()))
    for k in (0, 1):
        path = str(tmp_path / f"pages{k}")
        for row in pages[:: 1 - 2 * k]:
            spark.createDataFrame([row], PAGES).coalesce(1).write.mode("append").parquet(path)
        stream = incremental.read_stream(spark, path, table.schema, 3)
        sites.enrich_stream(stream, targets, str(tmp_path / f"out{k}"), str(tmp_path / f"mark{k}"), CONFIG).awaitTermination()
        assert sorted(map(str, sites.enriched(targets, str(tmp_path / f"out{k}")).collect())) == want


def test_timers_settle_sites(spark, tmp_path):
    """A site without pages for an hour is settled and forgotten; what comes later than the watermark allows is dropped."""
    targets = spark.createDataFrame([(s, s, f"https://{s}.org/", "", "c", "roof") for s in "ab"], TARGETS)
    waves = [site_rows(0, ("a", "", "static", "x@a.org")), site_rows(5, ("b", "", "static", "y@b.org")), site_rows(1, ("a", "/contact", "static", "jane@a.org"), ("a", "", "static", "bob@a.org")) + site_rows(6, ("b", "", "static", "z@b.org"))]
    path, out = str(tmp_path / "pages"), str(tmp_path / "out")
    for wave in waves:
        spark.createDataFrame(wave, PAGES).coalesce(1).write.mode("append").parquet(path)
        stream = incremental.read_stream(spark, path, StructType.fromDDL(PAGES), 1)
        sites.enrich_stream(stream, targets, out, str(tmp_path / "mark"), CONFIG, time="at", lateness="1 hour").awaitTermination()
    got = {r.key: (r.email, r.settled) for r in sites.site_table(spark, out).read().collect()}
    assert got == {"a": ("x@a.org", True), "b": ("y@b.org", False)}


def test_absorb_forgets_what_no_longer_counts():
    known = sites.absorb({}, [("static", 3, 1, "c@x", None, None), ("static", 4, 1, "d@x", "5", None), ("static", 1, 3, "info@x", "1", None)])
    assert set(known["static"]) == {1, 3} and sites.decide(known) == ("c@x", "1", None, 1)
    assert set(sites.absorb(known, [("static", 0, 2, "b@x", None, "N")])["static"]) == {0} and sites.decide(known) == ("b@x", None, "N", 1)
    assert sites.decide({}) == (None, None, None, None) and sites.decide({"static": {0: [None, None, "N"]}, "rendered": {2: [None, "7", None]}}) == (None, "7", None, 2)


def test_counts_in_update_mode(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("bing", k)] * (k + 1) + [("yahoo", k)] * (k == 0), "engine string, i int").write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.read_stream(spark, str(tmp_path / "in"), StructType.fromDDL("engine string, i int"))
        incremental.count_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert {r.engine: r.n for r in incremental.count_table(spark, str(tmp_path / "out")).read().collect()} == {"bing": 6, "yahoo": 1}


def test_state_stores_follow_the_visits(spark, tmp_path):
    """A session with many shuffle partitions doesn't give a small table many state stores, and keeps its setting."""
    targets = spark.createDataFrame([(s, s, f"https://{s}.org/", "", "c", "roof") for s in "ab"], TARGETS)
    path, before = str(tmp_path / "pages"), spark.conf.get(sites.PARTITIONS)
    spark.createDataFrame(site_rows(0, ("a", "", "static", "x@a.org")), PAGES).write.parquet(path)
    try:
        spark.conf.set(sites.PARTITIONS, "3")
        assert sites.stores(sites.visit_table(targets, CONFIG)) == 3
        spark.conf.set(sites.PARTITIONS, "300")
        stream = incremental.read_stream(spark, path, StructType.fromDDL(PAGES), 1)
        sites.enrich_stream(stream, targets, str(tmp_path / "out"), str(tmp_path / "mark"), CONFIG).awaitTermination()
        assert spark.conf.get(sites.PARTITIONS) == "300"
    finally:
        spark.conf.set(sites.PARTITIONS, before)
    assert len([d for d in os.listdir(tmp_path / "mark" / "state" / "0") if d.isdigit()]) == spark.sparkContext.defaultParallelism
    assert {r.email for r in sites.enriched(targets, str(tmp_path / "out")).collect()} >= {"x@a.org"}

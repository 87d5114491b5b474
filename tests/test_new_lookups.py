from pyspark.sql import functions as F

from leadloom.operators import diagnose, lookup, report
from leadloom.sources import leads


def test_without_seen(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("d"), (F.col("id") % 1500).cast("string"))).alias("domain"), "id", F.lit(1).alias("bits"))
    seen = spark.range(0, 1500, 7).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain")).unionByName(spark.createDataFrame([(None,)], "domain string"))
    got, want = lookup.without_seen(df, seen, "domain"), df.join(seen, "domain", "left_anti")
    assert got.columns == df.columns and sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert lookup.without_seen(df, seen.limit(0), "domain").count() == 3000
    false = spark.range(100_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("domain"))
    table = lookup.seen_filter(seen.filter("domain is not null"), "domain").collect()
    assert len(table) == 1 and table[0].blocks == 1 and len(table[0].bits) == 4096
    assert lookup.without_seen(false, seen, "domain").count() == 100_000


def test_only_what_may_be_seen_is_shuffled(spark):
    df = spark.range(100_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("domain"), F.lit("text").alias("title"))
    seen = spark.range(40_000).select(F.concat(F.lit("y"), F.col("id").cast("string")).alias("domain"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup.without_seen(df, seen, "domain")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sure, maybe = plan.split("SortMergeJoin")[0], plan.split("SortMergeJoin")[1]
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in sure.replace("BroadcastExchange", "") and maybe.count("Exchange hashpartitioning") == 2


def test_page_caps(spark):
    rows = [(e, p) for e in ("mojeek", "duckduckgo", "yahoo", "bing", None) for p in range(1, 14)]
    got = lookup.cap_pages(spark.createDataFrame(rows, "engine string, page_no int"), 12, {"duckduckgo": 9, "yahoo": 10, "bing": 9}).groupBy("engine").agg(F.max("page_no").alias("n")).collect()
    assert {r.engine: r.n for r in got} == {"mojeek": 12, "duckduckgo": 9, "yahoo": 10, "bing": 9, None: 12}


def test_coverage_of_a_hot_domain(spark):
    rows = [("bing", "a"), ("mojeek", "a"), ("mojeek", "a"), ("yahoo", "b"), ("yahoo", ""), ("bing", None)]
    got = {r.engine: (r.urls, r.new_domains) for r in diagnose.coverage(spark.createDataFrame(rows, "engine string, domain string"), ["mojeek", "yahoo", "bing"]).collect()}
    assert got == {"mojeek": (2, 2), "yahoo": (2, 1), "bing": (2, 0)}


def test_sketches_over_days(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("day"), F.when(F.col("id") % 2 == 0, "bing").otherwise("yahoo").alias("engine"), F.concat(F.lit("d"), (F.col("id") % 40_000).cast("string")).alias("domain"))
    kept = report.domain_sketches(df, ["day", "engine"])
    total = report.sketched_totals(kept).first()
    assert kept.count() == 10 and total.records == 60_000 and abs(total.unique_domains - 40_000) < 0.05 * 40_000
    by = {r.engine: r.unique_domains for r in report.sketched_totals(kept, ["engine"]).collect()}
    assert all(abs(n - 20_000) < 0.05 * 20_000 for n in by.values())
    assert kept.agg(F.max(F.length("sketch"))).first()[0] < 4200


def test_counts_of_the_writing_job(spark, tmp_path):
    table = spark.createDataFrame([("A", "https://a.org", "YES", "directory"), ("B", "https://b.org", "", ""), ("C", "", "YES", "directory"), ("D", "https://d.org", "YES", "pattern")], ["Company", "Website", "Flagged", "Flag Reason"])
    assert leads.write_usable(table, str(tmp_path / "out")) == {"written": 2, "skipped": 1, "no_website": 1}
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["B", "D"]

import pytest
from pyspark.sql import functions as F

from leadloom.config import LEAD_HEADERS, LeadConfig
from leadloom.operators import clean, lookup

RAW = "engine string, query_idx long, query string, page_no int, position long, url string, title string, snippet string"
CONFIG = LeadConfig(excluded_exact=["listed.org"], excluded_suffix=["parent.org"], geo_suspect_tlds=["ru"])


def leads(spark, rows, config=CONFIG, **options):
    raw = spark.createDataFrame([(e, 0, q, 1, i, u, t, "") for i, (e, q, u, t) in enumerate(rows)], RAW)
    return {r.domain: r for r in clean.clean_results(raw, config, **options).collect()}


def test_exclusions_and_first_engine(spark):
    got = leads(
        spark,
        [("bing", "roof", "https://firm.org/late", ""), ("mojeek", "roof", "https://www.firm.org/a/b?x=1", ""), ("yahoo", "roof", "https://listed.org/", ""), ("yahoo", "roof", "https://x.parent.org/", ""),
         ("yahoo", "roof", "https://notparent.org/", ""), ("yahoo", "roof", "https://a.com.stats.net/", ""), ("yahoo", "roof", "javascript:x", ""), ("yahoo", "roof", "https://www.google.com/aclk?x", "")],
    )
    assert set(got) == {"firm.org", "notparent.org"}
    assert (got["firm.org"].search_engine, got["firm.org"].website_url, got["firm.org"].company_name) == ("mojeek", "https://www.firm.org/", "Firm")


def test_flags(spark):
    got = leads(spark, [("yahoo", "roof repairs", "https://firm.ru/", "roof"), ("yahoo", "roof repairs", "https://cake.org/", "Cakes bakery | x"), ("yahoo", "roof repairs", "https://far.ru/", "Cakes bakery")])
    assert (got["firm.ru"].flag_reason, got["firm.ru"].score, got["firm.ru"].flagged) == ("geo-suspect", -2, True)
    assert (got["cake.org"].flag_reason, got["cake.org"].score, got["cake.org"].flagged) == ("irrelevant", -5, True)
    assert (got["far.ru"].flag_reason, got["far.ru"].score) == ("geo-suspect", -5)


def test_seen_and_order(spark):
    seen = spark.createDataFrame([("firm.org",)], "domain string")
    assert set(leads(spark, [("yahoo", "q", "https://firm.org/", ""), ("yahoo", "q", "https://new.org/", "")], seen=seen)) == {"new.org"}


def test_input_order_does_not_matter(spark):
    rows = [("yahoo", 0, "roof", 1, i, f"https://s{i % 7}.org/{i}", "roof", "") for i in range(60)]
    raw = spark.createDataFrame(rows, RAW)
    a = {tuple(r) for r in clean.clean_results(raw, CONFIG).collect()}
    b = {tuple(r) for r in clean.clean_results(raw.orderBy(F.rand(3)).repartition(7), CONFIG).collect()}
    assert a == b and len(a) == 7


def test_empty_and_nulls(spark):
    assert leads(spark, []) == {}
    assert leads(spark, [("yahoo", None, None, None), ("yahoo", None, "https://firm.org", None)])["firm.org"].flagged is False


def test_export(spark):
    raw = spark.createDataFrame([("yahoo", 0, "roof", 1, 0, "https://firm.ru/", "roof", "")], RAW)
    out = clean.export(clean.best_first(clean.clean_results(raw, CONFIG)), LEAD_HEADERS)
    assert out.columns == list(LEAD_HEADERS.values())
    assert out.first()["Flagged"] == "YES" and out.first()["Date Found"] == ""


def test_long_lists_take_the_join(spark, monkeypatch):
    df = spark.createDataFrame([("a.x.org",), ("y.org",), ("z.net",)], "domain string")
    monkeypatch.setattr(lookup, "LITERAL_LIST", 0)
    assert {r[0] for r in lookup.drop_suffixes(df, "domain", ["x.org"]).collect()} == {"y.org", "z.net"}
    assert {r[0] for r in lookup.drop_listed(df, "domain", ["y.org"]).collect()} == {"a.x.org", "z.net"}


def test_plan_is_one_shuffle_without_pages(spark, tmp_path):
    raw = spark.createDataFrame([("yahoo", 0, "roof", 1, i, f"https://s{i}.org/", "roof", "") for i in range(20)], RAW)
    raw.write.parquet(str(tmp_path / "raw"))
    plan = clean.clean_results(spark.read.parquet(str(tmp_path / "raw")), CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan and "NestedLoop" not in plan


def test_config_merge():
    c = LeadConfig(columns={"email": "Mail"}).merged({"columns": {"phone": "Tel"}, "engines": ["bing"], "unknown": 1})
    assert c.columns == {"email": "Mail", "phone": "Tel"} and c.engines == ["bing"]
    with pytest.raises(AttributeError):
        _ = c.unknown

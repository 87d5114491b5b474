from leadloom.config import LeadConfig
from leadloom.operators import enrich, report

CONFIG = LeadConfig(junk_email_domains=[], placeholder_domains=[], contact_paths=["/contact", "/about"])
TARGETS = "key string, name string, website string, phone string, category string, search_query string"
PAGES = "url string, html string, render_mode string, status int"


def run(spark, targets, pages, **options):
    t = spark.createDataFrame(targets, TARGETS)
    return {r.key: r for r in enrich.enrich(t, spark.createDataFrame(pages, PAGES), CONFIG, **options).collect()}


def target(key, phone="", query="roof repairs"):
    return (key, key.title(), f"https://{key}/", phone, "c", query)


def test_early_exit_and_best(spark):
    got = run(
        spark,
        [target("a.org"), target("b.org")],
        [("https://a.org", "sales@a.org", "static", 200), ("https://a.org/contact", "amy@a.org (0161) 496 1234", "static", 200), ("https://a.org/about", "aaa@a.org", "static", 200),
         ("https://b.org/", "<title>Roof Works</title> roof repairs contact us", "static", 200), ("https://www.b.org/contact/?x=1", "zoe@b.org", "static", 404), ("https://b.org/contact", "rita@b.org", "rendered", 200)],
    )
    assert (got["a.org"].email, got["a.org"].phone) == ("amy@a.org", "(0161) 496 1234")
    assert (got["b.org"].email, got["b.org"].lead_quality, got["b.org"].keyword_match_pct) == ("rita@b.org", "HOT", 100)


def test_input_phone_and_earlier(spark):
    earlier = spark.createDataFrame([("a.org", "Old", "https://a.org/", "old@a.org", None, "c", "WARM", 30)], "key string, name string, website string, email string, phone string, category string, lead_quality string, keyword_match_pct int")
    got = run(spark, [target("a.org"), target("b.org", "123"), target("c.org")], [("https://a.org", "new@a.org", "static", 200)], earlier=earlier)
    assert got["a.org"].email == "old@a.org" and got["b.org"].phone == "123" and "c.org" not in got


def test_reports(spark):
    t = spark.createDataFrame([target("a.org"), target("b.org"), target("c.org")], TARGETS)
    c = spark.createDataFrame([("a.org", "x@a.org", None, "HOT"), ("b.org", None, "1", None)], "key string, email string, phone string, lead_quality string")
    assert tuple(report.contact_rates(t, c).first()) == (3, 2, 1, 1, 1, 67, 33, 33)
    assert report.contact_rates(t.limit(0), c).first()["found_pct"] is None
    assert tuple(report.quality_distribution(c).first()) == (1, 0, 0, 0)


def test_last_name_wins(spark):
    rows = spark.createDataFrame([(" Acme ", "a", 1), ("acme", "b", 2), ("Other", "c", 0)], "name string, site string, input_pos int")
    assert {r.name_key: r.site for r in enrich.last_by_name(rows).collect()} == {"acme": "b", "other": "c"}


def test_pages_are_never_shuffled(spark, tmp_path):
    """No exchange carries page source, and pages are scanned once for both passes and the grade."""
    import re

    spark.createDataFrame([target("a.org")], TARGETS).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("https://a.org", "x@a.org", "static", 200)], PAGES).write.parquet(str(tmp_path / "p"))
    out = enrich.enrich(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "p")), CONFIG)
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    exchanges = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert exchanges and not any("html" in e for e in exchanges)
    assert len(re.findall(r"ReadSchema: struct<[^>]*html", plan)) == 1 and "CartesianProduct" not in plan

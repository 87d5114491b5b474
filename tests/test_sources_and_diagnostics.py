import pytest

from leadloom.operators import diagnose
from leadloom.sources import leads as lead_files
from leadloom.sources import queries, serp

PAD = "<p>" + "padding text " * 150 + "</p>"


def extract(spark, engine, html, status=200):
    pages = spark.createDataFrame([(engine, 0, "roof", 1, html, status)], "engine string, query_idx long, query string, page_no int, html string, http_status int")
    return [(r.url, r.title, r.snippet) for r in serp.extract_results(pages).orderBy("position").collect()]


def test_layouts(spark):
    assert extract(spark, "mojeek", f"<ul><li><a class='ob' href='https://a.org/1'>x</a><h2>A</h2><p class='s'>sa</p></li><li><a class='ob' href='https://a.org/2'>x</a></li><li><a class='ob' href='https://www.mojeek.com/x'>x</a></li></ul>{PAD}") == [("https://a.org/1", "A", "sa")]
    assert extract(spark, "mojeek", f"<div><h2><a href='https://b.org'>B</a></h2><p>sb</p></div>{PAD}") == [("https://b.org", "B", "sb")]
    assert extract(spark, "mojeek", "<h2><a href='https://b.org'>B</a></h2>") == []
    table = "<table><tr><td><a class='result-link' href='https://duckduckgo.com/l/?uddg=https%3A%2F%2Fc.org'>C</a></td></tr><tr><td class='result-snippet'>sc</td></tr></table>"
    assert extract(spark, "duckduckgo", table + PAD) == [("https://c.org", "C", "sc")]
    assert extract(spark, "duckduckgo", table) == [] and extract(spark, "duckduckgo", table + PAD, 202) == []
    assert extract(spark, "yahoo", f"<li><div class='compTitle'><h3><a href='https://r.yahoo.com/RU=https%3A%2F%2Fd.org/RK=1'>D https://d.org › x</a></h3></div><div class='compText'>sd</div></li>{PAD}") == [("https://d.org", "D", "sd")]
    assert extract(spark, "yahoo", f"<div><a href='https://r.yahoo.com/RU=https%3A%2F%2Fe.org/RK=1'>E</a><p>se</p></div>{PAD} captcha") == []
    assert extract(spark, "bing", f"<ol><li class='b_algo'><h2><a href='https://f.org/'>F</a></h2><p>sf</p></li></ol>{PAD}") == [("https://f.org/", "F", "sf")]
    rss = "<?xml version='1.0'?><rss><channel><item><link>https://g.org</link><title>G</title><description>&lt;b&gt;sg&lt;/b&gt;</description></item><item><link>https://h.org</link><title>データ処理</title></item></channel></rss>"
    assert extract(spark, "bing", rss) == [("https://g.org", "G", "sg")]
    assert extract(spark, "bing", "<?xml broken") == []


def test_new_layout(spark):
    serp.register("mine", lambda page: [(a.attributes["href"], a.text(), "") for a in page.all("a", "hit", "href")])
    try:
        assert extract(spark, "mine", "<a class='hit' href='https://i.org'>I</a>") == [("https://i.org", "I", "")]
    finally:
        del serp.LAYOUTS["mine"]


def test_queries(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n roof repairs \n\nroof repairs\nplumbers\n")
    (tmp_path / "q.csv").write_text("a,b\n1,plumbers\n2,painters\n")
    got = queries.union_in_order(queries.from_text(spark, str(tmp_path / "q.txt")), queries.from_csv(spark, str(tmp_path / "q.csv"), "b"), queries.literal(spark, " tilers "))
    assert [r.query for r in got.orderBy("position").collect()] == ["roof repairs", "plumbers", "painters", "tilers"]
    assert queries.resolve_engines(["DDG", "bing", "duckduckgo", "other"]) == ["duckduckgo", "bing"]


def test_lead_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Trading Name,Home URL,Tel,Flagged,Flag Reason\nAcme,https://a.org,1,,\nDir,https://d.org,2,YES,directory\nNo,,3,,\n")
    targets, skipped = lead_files.read_leads(spark, str(tmp_path / "in.csv"))
    assert [(r.key, r.website, r.phone) for r in targets.collect()] == [("acme", "https://a.org", "1")] and skipped.first()[0] == 1
    with pytest.raises(ValueError):
        lead_files.as_targets(spark.createDataFrame([(1,)], "n int"))
    contacts = spark.createDataFrame([("Acme", "https://a.org", "x@a.org", "+447", "c", None, None), ("None", "w", None, None, "c", None, None)], "name string, website string, email string, phone string, category string, lead_quality string, keyword_match_pct int")
    lead_files.write_contacts(contacts, str(tmp_path / "out"))
    again = lead_files.read_contacts(spark, str(tmp_path / "out"))
    assert [(r.key, r.email, r.phone) for r in again.collect()] == [("acme", "x@a.org", "+447")]
    assert lead_files.newest(spark, [str(tmp_path / "in.csv")]).endswith("in.csv")


def test_runs_of_refusals(spark):
    log = spark.createDataFrame([("e", q, a, s) for a, (q, s) in enumerate([(0, 200), (0, 429), (0, 429), (1, 200), (1, 429), (1, 429), (1, 429), (1, 200), (2, 200)])], "engine string, query_idx long, attempt long, http_status int")
    assert [tuple(r) for r in diagnose.ban_runs(log).collect()] == [("e", 4, 3)]
    assert diagnose.until_ban(log).count() == 8
    assert sorted(r.attempt for r in diagnose.until_failure(log).collect()) == [0, 3, 8]


def test_loops(spark):
    rows = [("e", 0, 1, "a"), ("e", 0, 1, "b"), ("e", 0, 2, "a"), ("e", 0, 3, "a"), ("e", 0, 3, "c")]
    got = diagnose.looping(spark.createDataFrame(rows, "engine string, query_idx long, page_no int, domain string"))
    assert {r.page_no: r.loops for r in got.collect()} == {2: True, 3: False}

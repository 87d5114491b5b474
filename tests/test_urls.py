from pyspark.sql import functions as F

from leadloom.functions import urls


def test_normal_form(values):
    got = values(
        urls.normalise_url,
        " https://Shop.Example.co.uk/A/b/?utm_source=x&q=a+b&empty=&REF=1#top ", "//WWW.firm.org", "ftp://firm.org/", "mailto:a@b.co", "http://firm.org/?q=%zz&r=1~2*", "", None,
    )
    assert got == ["https://shop.example.co.uk/A/b?q=a+b", "https://www.firm.org/", None, None, "http://firm.org/?q=%25zz&r=1~2%2A", None, None]


def test_domain_and_root(values):
    assert values(urls.base_domain, "https://WWW.Firm.org:8080/x", "http://m.firm.org", "no address", None) == ["firm.org", "m.firm.org", "", None]
    assert values(urls.site_root, "https://firm.org/a/b?x=1", "https://firm.org/?x=1", "https://firm.org/") == ["https://firm.org/", "https://firm.org/?x=1", "https://firm.org/"]


def test_name_from_domain(values):
    assert values(urls.name_from_domain, "green-park_lettings.co.uk", "JSmithBuilders.com", "northHarbour.io", "www.acme.info", ".com", "plain") == [
        "Green Park Lettings", "J Smith Builders", "North Harbour", "Acme", ".com", "Plain",
    ]


def test_rejects(values):
    assert values(urls.is_ad, "https://www.Bing.com/aclick?x", "https://x.doubleclick.net/", "https://firm.org/?ld=" + "a" * 300, "https://firm.org/?ld=a") == [True, True, True, False]
    assert values(urls.is_parasite, "shop.com.stats.net", "firm.co.uk", "a.firm.com") == [True, False, False]
    assert values(urls.label_suffixes, "a.b.co.uk") == [["a.b.co.uk", "b.co.uk", "co.uk", "uk"]]


def test_flags_and_scores(spark):
    df = spark.createDataFrame(
        [("https://a.org/search?q=1", "a.org"), ("https://a.org/x.PDF", "a.org"), ("https://a.b.c.d.org/", "a.b.c.d.org"), ("https://a.org/", "a.org"), ("https://best-a.org/x/y/z", "best-a.org"), ("https://a.org/uk/2023/x", "a.org")], "u string, d string"
    )
    got = [tuple(r) for r in df.select(urls.url_flag(F.col("u"), F.col("d")), urls.url_score(F.col("u"), ["best"])).collect()]
    assert got == [("pattern", 0), ("pattern", 0), ("deep-subdomain", 0), ("", 0), ("", -2), ("pattern", -1)]


def test_redirects(values):
    assert values(urls.unwrap_ru, "https://r.search.yahoo.com/x/RU=https%3A%2F%2Ffirm.org%2Fa+b/RK=2", "https://firm.org/", "https://help.yahoo.com/", "/local") == ["https://firm.org/a+b", "https://firm.org/", "", ""]
    assert values(urls.unwrap_uddg, "https://duckduckgo.com/l/?uddg=https%3A%2F%2Ffirm.org%2F%3Fa%3Db&rut=1", "https://duckduckgo.com/l/?u=https%253A%252F%252Ffirm.org", "https://firm.org/") == ["https://firm.org/?a=b", "https://firm.org", "https://firm.org/"]
    assert values(urls.unwrap_u, "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9maXJtLm9yZy8_YT1i&x=1", "https://firm.org/", "/url?q=https%3A%2F%2Ffirm.org&sa=1", "https://www.bing.com/x") == ["https://firm.org/?a=b", "https://firm.org/", "https://firm.org", ""]


def test_titles_and_language(spark, values):
    assert values(urls.clean_title, "Harbour Homes https://harbour.org › x", "Two   blanks › trail", "Plain") == ["Harbour Homes", "Two blanks", "Plain"]
    assert values(urls.title_head, "Harbour Homes | Leeds", "One – Two", None) == ["Harbour Homes", "One", ""]
    df = spark.createDataFrame([("Plumbers in Leeds", "short"), ("データ処理の会社", None), ("Plumbers", "x" * 60 + " see /de/ pages"), ("", ""), ("Plumbers", "é" * 20 + "a" * 40)], "t string, d string")
    assert [r[0] for r in df.select(urls.is_english(F.col("t"), F.col("d"))).collect()] == [True, False, False, True, False]

"""Health of stored result pages, coverage of engines, and rules that end a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.config import ENOUGH_RESULTS
from leadloom.functions.urls import is_english
from leadloom.operators.lookup import engine_rank, running
from leadloom.shared import shared_path

# Patterns and limits.
#: Patterns that count what a layout's results look like.
MARKERS = {
    "b_algo": r'<li[^>]*class="[^"]*\bb_algo\b',
    "comp_title": r'<div[^>]*class="[^"]*\bcompTitle\b',
    "ru_link": r'<a[^>]*href="[^"]*/RU=',
    "result_link": r'<a[^>]*class=["\'][^"\']*\bresult-link\b',
    "result_snippet": r'<td[^>]*class=["\'][^"\']*\bresult-snippet\b',
    "ob": r'<a[^>]*class="[^"]*\bob\b',
    "h2": r"<h2[\s>]",
    "http_link": r'<a[^>]*href=["\']http',
}
#: Least text of a layout's page, and whether a captcha mark blocks it.
BLOCKS = {"mojeek": (300, False), "duckduckgo": (1000, True), "yahoo": (300, True), "bing": (300, True)}


def page_health(status: Column, html: Column, engine: Column | None = None) -> Column:
    """What is wrong with a stored response, as an array of labels."""
    low = F.lower(html)
    challenge = low.contains("cloudflare") & status.isin(403, 503)
    short = (status == 200) & (F.length(html) < 5000)
    if engine is not None:
        short = short & (engine != "bing")
    return F.array_compact(
        F.array(
            F.when(challenge, "challenge"), F.when(~challenge & (low.contains("suspended") | low.contains("banned")), "banned"), F.when(low.contains("captcha"), "captcha"),
            F.when(short, "short"), F.when(F.regexp_count(html, F.lit("�")) > 50, "encoding"), F.when(status == 500, "error"), F.when(status == 202, "stale"),
        )
    )


def blocked(engine: Column, text: Column) -> Column:
    """Whether a layout's page is too short or a captcha."""
    out = F.lit(False)
    for name, (least, captcha) in BLOCKS.items():
        out = F.when(engine == name, (F.length(text) < least) | (F.lit(captcha) & F.lower(text).contains("captcha"))).otherwise(out)
    return out


def marker_counts(pages: DataFrame) -> DataFrame:
    """How often each layout's marks occur, by engine. Counts leave the scan, pages don't."""
    each = pages.select("engine", *[F.regexp_count("html", F.lit(p)).alias(k) for k, p in MARKERS.items()])
    return each.groupBy("engine").agg(*[F.sum(k).alias(k) for k in MARKERS])


def coverage(urls: DataFrame, engines: list[str]) -> DataFrame:
    """engine, urls, new_domains: addresses of each engine, and those whose domain no earlier engine had."""
    # summed by engine and domain before anything is shuffled, so that a hot domain is one row for each engine
    each = urls.groupBy("engine", "domain").agg(F.count("*").alias("_n")).withColumn("_rank", engine_rank(F.col("engine"), engines))
    least = each.filter("domain <> ''").groupBy("domain").agg(F.min("_rank").alias("_first"))
    new = F.sum(F.when(F.col("_rank") == F.col("_first"), F.col("_n")).otherwise(0))
    return each.join(least, "domain", "left").groupBy("engine").agg(F.sum("_n").alias("urls"), new.alias("new_domains"))


def yield_estimate(covered: DataFrame) -> DataFrame:
    """Unique domains a page may bring: four to six times the new ones."""
    return covered.agg(F.sum("new_domains").alias("new_domains")).select("new_domains", (F.col("new_domains") * 4).alias("low"), (F.col("new_domains") * 6).alias("high"))


def engine_health(results: DataFrame) -> DataFrame:
    """engine, n -> OK, PARTIAL or FAIL by the engine's threshold."""
    enough = F.coalesce(*[F.when(F.col("engine") == k, F.lit(v)) for k, v in ENOUGH_RESULTS.items()], F.lit(10))
    return results.select("engine", "n", F.when(F.col("n") >= enough, "OK").when(F.col("n") > 0, "PARTIAL").otherwise("FAIL").alias("health"))


def looping(results: DataFrame) -> DataFrame:
    """engine, query_idx, page_no, loops: whether a later page has only domains of page 1. By counts, without sets."""
    pages = results.filter("domain <> ''").select("engine", "query_idx", "page_no", "domain").distinct()
    known = pages.withColumn("_on_first", F.max((F.col("page_no") == 1).cast("int")).over(Window.partitionBy("engine", "query_idx", "domain")))
    return known.filter("page_no > 1").groupBy("engine", "query_idx", "page_no").agg((F.min("_on_first") == 1).alias("loops"))


def all_rejected(results: DataFrame) -> DataFrame:
    """engine, query_idx: whether page 1 had results and none is in English."""
    ok = is_english(F.col("title"), F.col("snippet"))
    return results.filter("page_no = 1").groupBy("engine", "query_idx").agg((F.count_if(ok) == 0).alias("all_rejected"))


#: Attempts that one task orders.
BUCKET_ATTEMPTS = 100_000


def _runs(log: DataFrame) -> DataFrame:
    """log with _group: how many other statuses an engine has had before, which is the same for all 429 in a row."""
    return running(log, ["engine"], [F.col("attempt")], F.floor(F.col("attempt") / BUCKET_ATTEMPTS), (F.col("http_status") != 429).cast("int"), "_group")


def ban_runs(log: DataFrame, least: int = 3) -> DataFrame:
    """engine, run_start, run_length of each run of `least` statuses 429 or more in a row, by attempt."""
    runs = _runs(log).filter("http_status = 429")
    return runs.groupBy("engine", "_group").agg(F.min("attempt").alias("run_start"), F.count("*").alias("run_length")).filter(F.col("run_length") >= least).drop("_group")


def until_ban(log: DataFrame, least: int = 3) -> DataFrame:
    """Attempts up to the end of the query in which an engine's ban falls."""
    refused = running(_runs(log).filter("http_status = 429"), ["engine"], [F.col("attempt")], F.floor(F.col("attempt") / BUCKET_ATTEMPTS), F.lit(1), "_place")
    runs = refused.groupBy("engine", "_group").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    # the attempt by which a run is long enough, by its place among the engine's refusals: one row a run
    last = refused.join(runs.select("engine", (F.col("_first") + least - 1).alias("_place")), ["engine", "_place"])
    ban = last.groupBy("engine").agg(F.min("query_idx").alias("_ban"))
    return log.join(ban, "engine", "left").filter("_ban is null or query_idx <= _ban").drop("_ban")


def until_failure(log: DataFrame) -> DataFrame:
    """Pages of each query before the first that didn't load."""
    order = Window.partitionBy("engine", "query_idx").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.max((~F.col("http_status").isin(200, 202)).cast("int")).over(order)
    return log.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def sample_urls(urls: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct addresses of each engine, in order of position."""
    first = urls.groupBy("engine", "url").agg(F.min("position").alias("position"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("engine").orderBy("position", "url"))).filter(F.col("place") <= n)


def engine_diagnostics(pages: DataFrame, results: DataFrame, engines: list[str]) -> dict[str, DataFrame]:
    """All reports on stored result pages (engine, http_status, html, ...) and the results extracted from them (engine, url, domain, position, ...).

    Results are kept, so that pages are parsed once and not for each report.
    """
    path = shared_path(results.sparkSession, "results")
    results.select("engine", "query_idx", "page_no", "position", "url", "title", "snippet", "domain").write.parquet(path)
    results = results.sparkSession.read.parquet(path)
    covered = coverage(results, engines)
    found = pages.select("engine").distinct().join(results.groupBy("engine").agg(F.count("*").alias("n")), "engine", "left").select("engine", F.coalesce("n", F.lit(0)).alias("n"))
    return {
        "health": pages.select("engine", "query_idx", "page_no", page_health(F.col("http_status"), F.col("html"), F.col("engine")).alias("labels")),
        "markers": marker_counts(pages), "engines": engine_health(found), "samples": sample_urls(results), "coverage": covered, "yield": yield_estimate(covered), "loops": looping(results), "rejected": all_rejected(results),
    }

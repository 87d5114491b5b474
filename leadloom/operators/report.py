"""Summaries of leads, contacts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.config import ENGINE_ALIASES
from leadloom.operators.enrich import QUALITIES
from leadloom.shared import shared_path

#: Logarithm of a sketch's buckets: 4 kB at most.
SKETCH_BITS = 12


def lead_totals(leads: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("domain") if approximate else F.countDistinct("domain")
    return leads.agg(F.count("*").alias("total_records"), distinct.alias("unique_domains"), F.count_if("flagged").alias("flagged_records"), F.count_if(~F.col("flagged")).alias("clean_records"))


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def engine_counts(leads: DataFrame) -> DataFrame:
    return counts(leads, "search_engine").orderBy("search_engine")


def top_queries(leads: DataFrame, k: int = 20, width: int = 45) -> DataFrame:
    """The k queries with most leads, shortened; ties by name."""
    top = counts(leads, "search_query").orderBy(F.desc("n"), "search_query").limit(k)
    return top.select(F.substring("search_query", 1, width).alias("search_query"), "n")


def engine_stats(leads: DataFrame, raw: DataFrame) -> DataFrame:
    """Leads kept and pages seen of each engine."""
    pages = raw.select("engine", "query_idx", "page_no").distinct().groupBy("engine").agg(F.count("*").alias("pages"))
    return pages.join(counts(leads.withColumnRenamed("search_engine", "engine"), "engine", "leads"), "engine", "left").select("engine", F.coalesce("leads", F.lit(0)).alias("leads"), "pages")


def domain_sketches(leads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, records, sketch: a mergeable distinct-count sketch of the domains of each group (a day and engine, say), to be kept with the leads."""
    return leads.groupBy(*keys).agg(F.count("*").alias("records"), F.hll_sketch_agg("domain", SKETCH_BITS).alias("sketch"))


def sketched_totals(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """records and unique_domains (a sketch's estimate) over all groups, or by some of their keys, from sketches alone.

    The estimate's standard error is 0.83 / sqrt(2**SKETCH_BITS), 1.3 %; up to some hundred domains it is exact.
    """
    return sketches.groupBy(*(keys or [])).agg(F.sum("records").alias("records"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_domains"))


def category_counts(leads: DataFrame, column: str = "category") -> DataFrame:
    return counts(leads, column).orderBy(F.desc("n"), column)


def engine_tag(leads: DataFrame) -> DataFrame:
    """The engines in order of their full names, short names joined."""
    short = {v: k for k, v in ENGINE_ALIASES.items()}
    engines = F.array_sort(F.collect_set(F.lower(F.trim("search_engine"))))
    shorten = lambda e: F.coalesce(*[F.when(e == k, F.lit(v)) for k, v in short.items()], e)
    return leads.agg(F.array_join(F.transform(F.filter(engines, lambda e: e != ""), shorten), "_").alias("engine_tag"))


def output_name(leads: DataFrame, day: Column, at: Column) -> DataFrame:
    """The name under which a run's leads are written: the day and its engines in short, or without any the time."""
    short = {v: k for k, v in ENGINE_ALIASES.items()}
    engines = F.array_sort(F.collect_set(F.lower(F.trim("search_engine"))))
    shorten = lambda e: F.coalesce(*[F.when(e == k, F.lit(v)) for k, v in short.items()], e)
    tag = F.array_join(F.transform(F.filter(engines, lambda e: e != ""), shorten), "-")
    stem = leads.agg(tag.alias("tag")).select(F.concat_ws("_", F.lit("leads"), F.date_format(day, "yyyy-MM-dd"), F.coalesce(F.nullif("tag", F.lit("")), F.date_format(at, "HH-mm"))).alias("output_name"))
    return stem


def contact_rates(targets: DataFrame, contacts: DataFrame) -> DataFrame:
    """Targets, those with any contact, an email, a phone, none, and rounded shares (null without targets)."""
    out = targets.select("key").join(contacts.select("key", "email", "phone"), "key", "left").agg(
        F.count("*").alias("total"), F.count_if(F.expr("email is not null or phone is not null")).alias("found"), F.count("email").alias("with_email"), F.count("phone").alias("with_phone")
    )
    share = lambda c: F.bround(F.lit(100.0) * F.col(c) / F.nullif("total", F.lit(0)), 0).cast("int").alias(f"{c}_pct")
    return out.select("total", "found", "with_email", "with_phone", (F.col("total") - F.col("found")).alias("missing"), share("found"), share("with_email"), share("with_phone"))


def quality_distribution(contacts: DataFrame) -> DataFrame:
    """One row with the number of contacts of each quality."""
    return contacts.agg(*[F.count_if(F.col("lead_quality") == q).alias(q.lower()) for q in QUALITIES])


def progress(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries done, in all, and the percentage with one decimal."""
    out = queries.join(done.select("query", F.lit(1).alias("is_done")).distinct(), "query", "left").agg(F.count("is_done").alias("done"), F.count("*").alias("total"))
    return out.withColumn("pct", F.coalesce(F.round(F.lit(100.0) * F.col("done") / F.nullif("total", F.lit(0)), 1), F.lit(0.0)))


def run_plan(pending: DataFrame, engines: list[str]) -> DataFrame:
    """Searches that remain: pending queries times engines."""
    return pending.agg(F.count("*").alias("pending")).select("pending", F.lit(len(engines)).cast("long").alias("engines"), (F.col("pending") * len(engines)).alias("operations"))


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """All rows with their place in an order that tells every two of them apart.

    Rows are dealt by ranges of the order and ranked inside each; what stands before a range is a running sum over
    ranges. They are kept in between, so that both see the same ranges.
    """
    path = shared_path(df.sparkSession, "placed")
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = kept.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    inside = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(F.broadcast(starts), "_range").withColumn("place", F.col("_before") + F.col("_rank")).select(*[F.col(f"`{c}`") for c in df.columns], "place")

"""Incremental runs over arriving results and pages, with Structured Streaming."""

from __future__ import annotations

from time import monotonic, sleep

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leadloom.config import LeadConfig
from leadloom.operators.clean import clean_results, drop_excluded, with_domains
from leadloom.operators.enrich import page_facts, relevance, visit_key
from leadloom.operators.lookup import engine_rank, without
from leadloom.sources import versions
from leadloom.streaming.runs import RunTable


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def dedupe_stream(raw: DataFrame, config: LeadConfig | None = None, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each domain of an unbounded stream.

    With a time column, state is bounded: rows later than the watermark (`delay` behind the latest time seen before the batch) are
    dropped, and a domain is forgotten once the watermark has passed the time of its first arrival by `delay`; an arrival after that
    comes through again.
    """
    out = drop_excluded(with_domains(raw), config or LeadConfig())
    return out.withWatermark(time, delay).dropDuplicatesWithinWatermark(["domain"]) if time else out.dropDuplicates(["domain"])


LEAD = "company_name string, website_url string, domain string, search_query string, search_engine string, date_found timestamp, flagged boolean, flag_reason string, score int, query_idx long, page_no int, position long"


def lead_table(spark: SparkSession, path: str, config: LeadConfig | None = None) -> RunTable:
    """Leads by domain; of a domain's leads the one that cleaning all results at once would keep counts."""
    rank = engine_rank(F.col("search_engine"), (config or LeadConfig()).engines)
    return RunTable(spark, path, StructType.fromDDL(LEAD), "domain", [rank, F.col("query_idx"), F.col("page_no"), F.col("position")])


def upsert_stream(raw: DataFrame, path: str, checkpoint: str, config: LeadConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Arriving results as leads below path; lead_table(...).read() gives what clean_results gives of all that has arrived, in any order.

    A lead that a better engine (query, page, place) finds later replaces the earlier one. No batch reads what others wrote.
    """
    config = config or LeadConfig()

    def batch(rows: DataFrame, number: int) -> None:
        lead_table(rows.sparkSession, path, config).put(clean_results(rows, config), number)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def until(run: StreamingQuery, batches: int, seconds: float = 600) -> None:
    """Waits until a running stream has done so many batches, or raises TimeoutError; a stream that has failed raises its own error."""
    end = monotonic() + seconds
    while run.lastProgress is None or run.lastProgress["batchId"] < batches - 1:
        if run.exception():
            raise run.exception()
        if monotonic() > end:
            raise TimeoutError(f"no {batches} batches in {seconds} s")
        sleep(0.05)


def grade_stream(pages: DataFrame, leads: DataFrame, config: LeadConfig | None = None) -> DataFrame:
    """Contacts and relevance of arriving home pages of known leads (a static table)."""
    homes = leads.select("domain", "search_query", visit_key(F.col("website_url")).alias("page_key"))
    facts = page_facts(pages, config)
    return facts.join(homes, "page_key").select("domain", "emails", "phones", *[v.alias(k) for k, v in relevance(F.col("body"), F.col("search_query")).items()])


def live_counts(leads: DataFrame, by: str = "engine") -> DataFrame:
    """Running counts; for the update or complete mode."""
    return leads.groupBy(by).agg(F.count("*").alias("n"))


def count_table(spark: SparkSession, path: str, by: str = "engine") -> RunTable:
    return RunTable(spark, path, StructType.fromDDL(f"{by} string, n long, batch long"), by, [F.desc("batch")])


def count_stream(leads: DataFrame, path: str, checkpoint: str, by: str = "engine", trigger: dict | None = None) -> StreamingQuery:
    """Live counters: each batch hands on the counts that changed, and count_table(...).read() has the latest of each."""

    def put(rows: DataFrame, batch: int) -> None:
        count_table(rows.sparkSession, path, by).put(rows.withColumn("batch", F.lit(batch).cast("long")), batch)

    counts = live_counts(leads, by)
    return counts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def save_progress(done: DataFrame, path: str, run: str) -> None:
    """Progress of a run under a new version; readers take complete ones only."""
    done.write.mode("errorifexists").parquet(f"{path}/run={run}")


def load_progress(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame | None:
    """The latest version, of the named ones or of all, that was written to its end, or None.

    Versions are in order of their numbers (10 after 9), or of the time they were done if they have other names. One without
    _SUCCESS was broken off and doesn't count.
    """
    there = [run for run in versions.complete(spark, path) if runs is None or run in runs]
    return spark.read.parquet(f"{path}/run={there[-1]}") if there else None


def pending(queries: DataFrame, done: DataFrame | None) -> DataFrame:
    """Searches (engine, query) that remain; a fresh start has none done."""
    return queries if done is None else without(queries, done, ["engine", "query"])



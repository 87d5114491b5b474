"""Enrichment that keeps state by site while pages arrive, in any order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from leadloom.config import LeadConfig
from leadloom.functions import contacts
from leadloom.operators.enrich import page_facts, relevance, visit_key, visit_plan, with_found
from leadloom.shared import shared_path
from leadloom.streaming.runs import RunTable

RESULT = "key string, email string, phone string, page_name string, pass int, lead_quality string, keyword_match_pct int, settled boolean"
STATE = "visits string, grade string, latest string, shown string"
KINDS = {name: {"string": "string", "int": "Int32", "boolean": "bool"}[kind] for name, kind in (c.split() for c in RESULT.split(", "))}
MODES = ("static", "rendered")
#: Visits of the table of visits for each state store: a store costs a file and a commit in every batch, however little it holds.
STORE_VISITS = 200_000
#: Visits of the table of visits whose page keys are sent to every machine, so that nothing is worked out of pages that no target visits.
SENT_VISITS = 200_000
PARTITIONS = "spark.sql.shuffle.partitions"


def visit_table(targets: DataFrame, config: LeadConfig | None = None) -> DataFrame:
    """Every target's visits of both modes with its query, written once, so that batches join a small table and not what targets are made of."""
    config = config or LeadConfig()
    plans = [visit_plan(targets, config, m, ["search_query"]).withColumn("render_mode", F.lit(m)) for m in MODES]
    path, plan = shared_path(targets.sparkSession, "visits"), plans[0].unionByName(plans[1])
    plan.write.parquet(path)
    return targets.sparkSession.read.schema(plan.schema).parquet(path)


def stores(plan: DataFrame) -> int:
    """State stores for the sites of a visit_table: by its rows, at least one for each core, at most the session's shuffle partitions."""
    spark = plan.sparkSession
    return min(int(spark.conf.get(PARTITIONS)), max(spark.sparkContext.defaultParallelism, -(-plan.count() // STORE_VISITS)))


def visited(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Pages that a visit of the plan asks for. Of a plan with more than SENT_VISITS rows all pages stay: pages themselves are never shuffled."""
    if plan.count() > SENT_VISITS:
        return pages
    keys = F.broadcast(plan.select(F.col("page_key").alias("_key"), F.col("render_mode").alias("_mode")))
    return pages.join(keys, (visit_key(pages["url"]) == F.col("_key")) & (pages["render_mode"] == F.col("_mode")), "left_semi")


def visits(pages: DataFrame, plan: DataFrame, config: LeadConfig | None = None, time: str | None = None) -> DataFrame:
    """What each arriving page says of the targets that it belongs to (plan: a visit_table): no page source or text goes on.

    key, render_mode, visit, the page's best email with its score, its first phone, its name, and of a static home page the grade.
    """
    facts = page_facts(visited(pages, plan), config, [time] if time else []).withColumn("body", F.when(F.col("render_mode") == "static", F.col("body"))).join(plan, ["page_key", "render_mode"])
    scored = F.transform("emails", lambda e: F.struct(contacts.email_score(e, config).alias("score"), F.lower(F.trim(e)).alias("email")))
    home = (F.col("visit") == 0) & (F.col("render_mode") == "static") & (F.col("search_query") != "")
    grade = F.when(home, F.struct(*[v.alias(k) for k, v in relevance(F.col("body"), F.col("search_query")).items()]))
    shown = facts.select(
        "key", "render_mode", "visit", F.array_min(F.filter(scored, lambda s: s["score"] < 999)).alias("best"), F.get("phones", F.lit(0)).alias("phone"),
        F.when(F.col("visit") == 0, F.col("page_name")).alias("page_name"), grade.alias("grade"), *([time] if time else []),
    )
    return shown.select("key", "render_mode", "visit", "best.score", "best.email", "phone", "page_name", "grade.lead_quality", F.col("grade.keyword_match_pct").alias("pct"), *([F.col(time).alias("time")] if time else []))


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def absorb(known: dict, rows: list[tuple]) -> dict:
    """known: {mode: {visit: [[score, email], phone, name]}} with rows (mode, visit, score, email, phone, name) taken in.

    Early exit: of each mode, visits after the first with an email scored 2 or better are forgotten, and none is taken in again.
    """
    for mode, visit, score, email, phone, name in rows:
        have = known.setdefault(mode, {})
        best, old_phone, old_name = have.get(visit, [None, None, None])
        have[visit] = [_least(best, None if email is None else [score, email]), _least(old_phone, phone), name if old_name is None else old_name if name is None else max(old_name, name)]
    for mode, have in known.items():
        last = min((v for v, x in have.items() if x[0] and x[0][0] <= 2), default=None)
        known[mode] = {v: x for v, x in have.items() if last is None or v <= last}
    return known


def decide(known: dict) -> tuple:
    """email, phone, name, pass: from static pages, or if they give no contact from rendered ones."""
    for number, mode in enumerate(MODES, 1):
        have = known.get(mode, {})
        email = min(((x[0][0], v, x[0][1]) for v, x in have.items() if x[0]), default=(None, None, None))[2]
        phone = min(((v, x[1]) for v, x in have.items() if x[1] is not None), default=(None, None))[1]
        if email is not None or phone is not None:
            return email, phone, have.get(0, [None, None, None])[2], number
    return None, None, None, None


def _site(idle_ms: int | None, timed: bool):
    def plain(x):
        return None if pd.isna(x) else x

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        visits_text, grade_text, latest, shown = state.get if state.exists else ("{}", "null", "0", "")
        known = {m: {int(v): x for v, x in have.items()} for m, have in json.loads(visits_text).items()}
        grade = json.loads(grade_text)
        row = lambda settled: pd.DataFrame([(key[0], *decide(known), *(grade or (None, None)), settled)], columns=list(KINDS)).astype(KINDS)
        if state.hasTimedOut:
            state.remove()
            yield row(True)
            return
        newest = int(latest)
        for b in batches:
            absorb(known, [(r.render_mode, int(r.visit), None if pd.isna(r.score) else int(r.score), plain(r.email), plain(r.phone), plain(r.page_name)) for r in b.itertuples(index=False)])
            for r in b.itertuples(index=False):
                if plain(r.lead_quality) is not None:
                    grade = _least(grade, [r.lead_quality, int(r.pct)])
            if timed and len(b):
                newest = max(newest, int(b["time"].max().timestamp() * 1000))
        out = row(False)
        now = json.dumps(out.astype(object).where(out.notna(), None).to_dict("list"))
        state.update((json.dumps(known), json.dumps(grade), str(newest), now))
        if timed:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        elif idle_ms:
            state.setTimeoutDuration(idle_ms)
        if now != shown:
            yield out

    return run


def site_updates(pages: DataFrame, targets: DataFrame, config: LeadConfig | None = None, time: str | None = None, lateness: str = "1 hour", idle_ms: int | None = None, plan: DataFrame | None = None) -> DataFrame:
    """A streaming table (RESULT) with a site's row each time it changes, for the update mode.

    State is a site's visits that still count (as many as there are contact paths, for each mode), its grade and the row last
    shown. After `idle_ms` without a page a timer settles the site: its row comes once more with settled, and the state goes.
    With a time column timers follow its watermark (an hour's idleness unless said otherwise) and pages later than `lateness` are
    dropped. Without one they follow the machine's clock and nothing is dropped: a page after the timer starts its site
    anew; such a stream runs until it is stopped, even when its trigger is availableNow. Without both, sites stay open.
    plan: the targets' visit_table where there is one already.
    """
    idle_ms = 3_600_000 if time and idle_ms is None else idle_ms
    arriving = visits(pages.withWatermark(time, lateness) if time else pages, visit_table(targets, config) if plan is None else plan, config, time)
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return arriving.groupBy("key").applyInPandasWithState(_site(idle_ms, bool(time)), RESULT, STATE, "update", timeout)


def site_table(spark: SparkSession, path: str) -> RunTable:
    """Sites by key; what was shown last counts."""
    return RunTable(spark, path, StructType.fromDDL(RESULT).add("batch", "long"), "key", [F.desc("batch"), F.desc("settled")])


def enrich_stream(pages: DataFrame, targets: DataFrame, path: str, checkpoint: str, config: LeadConfig | None = None, trigger: dict | None = None, **timers) -> StreamingQuery:
    """Enriches targets (a static table) with pages as they arrive; enriched() reads the results at any time.

    The stream gets as many shuffle partitions as stores() says, taken by Spark from the session when it starts, so the
    session's own number is set back at once. A restart keeps the number that its checkpoint has.
    """

    def put(rows: DataFrame, batch: int) -> None:
        site_table(rows.sparkSession, path).put(rows.withColumn("batch", F.lit(batch).cast("long")), batch)

    spark, plan = pages.sparkSession, visit_table(targets, config)
    updates = site_updates(pages, targets, config, plan=plan, **timers)
    before, own = spark.conf.get(PARTITIONS), stores(plan)
    spark.conf.set(PARTITIONS, own)
    try:
        return updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PARTITIONS, before)


def enriched(targets: DataFrame, path: str) -> DataFrame:
    """What enrich() gives, from the pages that have arrived so far."""
    found = site_table(targets.sparkSession, path).read().select("key", "email", F.col("phone").alias("_found"), "page_name", "lead_quality", "keyword_match_pct")
    return with_found(targets, found)

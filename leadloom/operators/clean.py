"""Cleaning of raw search results into leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.config import LeadConfig
from leadloom.functions import urls
from leadloom.functions.tokens import unrelated
from leadloom.operators.lookup import drop_listed, drop_suffixes, engine_rank, first_by, without


def with_domains(raw: DataFrame) -> DataFrame:
    """raw with url_norm and domain, without ads and what is no web address."""
    out = raw.filter(~urls.is_ad(F.col("url"))).withColumn("url_norm", urls.normalise_url(F.col("url"))).filter("url_norm is not null")
    return out.withColumn("domain", urls.base_domain(F.col("url_norm"))).filter("domain <> ''")


def drop_excluded(df: DataFrame, config: LeadConfig) -> DataFrame:
    """Without directories and platforms (exact), excluded domains and all below them, and parasite hosts."""
    out = drop_suffixes(drop_listed(df, "domain", config.excluded_exact), "domain", config.excluded_suffix)
    return out.filter(~urls.is_parasite(F.col("domain")))


def arrival(config: LeadConfig) -> list[Column]:
    """The order in which results are found: engine, query, page, position."""
    return [engine_rank(F.col("engine"), config.engines), F.col("query_idx"), F.col("page_no"), F.col("position")]


def assess(df: DataFrame, config: LeadConfig, url: str = "website_url") -> DataFrame:
    """df with flagged, flag_reason, score. A suspicious ending of the domain overrides the reason; an unrelated title sets the score and a blank reason."""
    reason = urls.url_flag(F.col(url), F.col("domain"))
    score = urls.url_score(F.col(url), config.boost_keywords)
    geo = F.substring_index("domain", ".", -1).isin(config.geo_suspect_tlds) if config.geo_suspect_tlds else F.lit(False)
    out = df.withColumns({"_reason": F.when(geo, "geo-suspect").otherwise(reason), "_score": score - F.when(geo, 2).otherwise(0), "_far": unrelated(urls.title_head(F.col("title")), F.col("query"))})
    return out.select(
        *df.columns,
        ((F.col("_reason") != "") | F.col("_far")).alias("flagged"),
        F.when(F.col("_far") & (F.col("_reason") == ""), "irrelevant").otherwise(F.col("_reason")).alias("flag_reason"),
        F.when(F.col("_far"), -5).otherwise(F.col("_score")).cast("int").alias("score"),
    )


def clean_results(raw: DataFrame, config: LeadConfig | None = None, seen: DataFrame | None = None, found_at: Column | None = None) -> DataFrame:
    """Leads from raw results (engine, query_idx, query, page_no, position, url, title, snippet).

    One shuffle, by domain, of rows that have passed all exclusions. seen: domains of earlier runs. found_at: the time to
    stamp; null without it. Order columns stay, so that callers can sort as results arrived.
    """
    config = config or LeadConfig()
    out = drop_excluded(with_domains(raw), config)
    if seen is not None:
        out = without(out, seen, ["domain"])
    out = first_by(out.drop("snippet", "url"), ["domain"], arrival(config))
    out = out.withColumn("website_url", urls.site_root(F.col("url_norm"), F.col("domain"), config.keep_full_url))
    out = assess(out, config, "url_norm" if config.assess_on == "raw" else "website_url")
    return out.select(
        urls.name_from_domain(F.col("domain")).alias("company_name"), "website_url", "domain", F.col("query").alias("search_query"), F.col("engine").alias("search_engine"),
        (found_at if found_at is not None else F.lit(None).cast("timestamp")).alias("date_found"), "flagged", "flag_reason", "score", "query_idx", "page_no", "position",
    )


def best_first(leads: DataFrame, config: LeadConfig | None = None) -> DataFrame:
    """Leads by score, those of one score as they arrived."""
    rank = engine_rank(F.col("search_engine"), (config or LeadConfig()).engines)
    return leads.orderBy(F.desc("score"), rank, "query_idx", "page_no", "position")


def export(leads: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Leads under display headers, in their order; flags as YES or nothing, times in ISO form, nothing null."""
    shown = {
        "flagged": F.when(F.col("flagged"), "YES").otherwise(""),
        "date_found": F.coalesce(F.date_format("date_found", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
    }
    return leads.select(*[shown.get(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c != "score" else F.col(c)).alias(h) for c, h in headers.items()])

"""Lead and contact tables in CSV: reading by header role, writing under display headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadloom.config import LEAD_HEADERS, LeadConfig
from leadloom.operators.clean import export

# Words that give a header its role, in order of preference.
ROLES = {
    "website": ["website", "url", "domain", "site", "web", "link", "homepage"],
    "name": ["company", "name", "organisation", "organization", "business", "firm", "client", "account", "brand", "title"],
    "category": ["category", "type", "sector", "industry", "segment", "group", "vertical"],
    "phone": ["phone", "tel", "mobile", "cell", "number", "contact number"],
    "search_query": ["search_query", "query", "search"],
    "flagged": ["flagged"],
    "flag_reason": ["flag_reason"],
    "search_engine": ["search_engine", "engine", "source"],
}


def detect(headers: list[str], role: str, wanted: str = "") -> str | None:
    """The header of a role: the configured one, else the first that holds the earliest possible word. Blanks count as underscores."""
    if wanted in headers:
        return wanted
    plain = {h: re.sub(r"[^a-z0-9]+", "_", h.lower()) for h in headers}
    return next((h for word in ROLES[role] for h in headers if word in plain[h] or word in h.lower()), None)


def as_targets(table: DataFrame, config: LeadConfig | None = None) -> DataFrame:
    """key, name, website, phone, category, search_query, flagged, flag_reason of a table with any headers, in input order (input_pos).

    Raises ValueError without a website column; the first column serves as a missing name.
    """
    columns = (config or LeadConfig()).columns
    found = {role: detect(table.columns, role, columns.get({"name": "company_name"}.get(role, role), "")) for role in ROLES}
    if not found["website"]:
        raise ValueError(f"no column for a website among {table.columns}")
    found["name"] = found["name"] or table.columns[0]
    value = lambda role: F.trim(F.coalesce(F.col(f"`{found[role]}`").cast("string"), F.lit(""))) if found[role] else F.lit("")
    return table.select(
        F.lower(value("name")).alias("key"), value("name").alias("name"), value("website").alias("website"), value("phone").alias("phone"), value("category").alias("category"),
        value("search_query").alias("search_query"), (F.upper(value("flagged")) == "YES").alias("flagged"), F.lower(value("flag_reason")).alias("flag_reason"), F.monotonically_increasing_id().alias("input_pos"),
    )


def read_leads(spark: SparkSession, path: str, config: LeadConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets that can be enriched, one row with the number of directory rows skipped)."""
    targets = as_targets(spark.read.csv(path, header=True), config)
    directory = F.col("flagged") & (F.col("flag_reason") == "directory")
    return targets.filter((F.col("website") != "") & ~directory), targets.agg(F.count_if(directory & (F.col("website") != "")).alias("skipped"))


def newest(spark: SparkSession, paths: list[str]) -> str | None:
    """The file that was changed last, by what the file system says: no content is read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Earlier contacts (display headers) that have an email or a phone, keyed by name."""
    table = spark.read.csv(path, header=True)
    lower = {re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_"): c for c in table.columns}
    names = {"name": "company_name", "website": "website", "email": "email", "phone": "phone", "category": "category", "lead_quality": "lead_quality", "keyword_match_pct": "keyword_match"}
    cell = lambda c: F.nullif(F.trim(F.col(f"`{lower[c]}`")), F.lit("")) if c in lower else F.lit(None).cast("string")
    out = table.select(F.lower(F.coalesce(cell("company_name"), F.lit(""))).alias("key"), *[cell(c).alias(k) for k, c in names.items()])
    return out.withColumn("keyword_match_pct", F.expr("try_cast(keyword_match_pct as int)")).filter("email is not null or phone is not null")


def write_leads(leads: DataFrame, path: str, by_day: bool = False) -> None:
    """Leads as CSV under display headers; by_day: a folder for each day they were found."""
    out = export(leads, LEAD_HEADERS)
    if by_day:
        out.withColumn("run_date", F.substring("Date Found", 1, 10)).write.partitionBy("run_date").csv(path, header=True)
    else:
        out.write.csv(path, header=True)


def write_usable(table: DataFrame, path: str, config: LeadConfig | None = None) -> dict[str, int]:
    """Writes the targets of a table that can be enriched, as Parquet; how many were written, and how many directory rows and rows
    without a website were left out, is counted by the job that writes."""
    targets = as_targets(table, config)
    directory = F.col("flagged") & (F.col("flag_reason") == "directory") & (F.col("website") != "")
    seen = Observation("usable")
    counted = targets.observe(
        seen, F.count_if((F.col("website") != "") & ~directory).alias("written"), F.count_if(directory).alias("skipped"), F.count_if(F.col("website") == "").alias("no_website")
    )
    counted.filter((F.col("website") != "") & ~directory).write.parquet(path)
    return seen.get


def contact_export(contacts: DataFrame, headers: dict | None = None) -> DataFrame:
    """Contacts under display headers; phones stay text, quality columns are always there, nothing is null."""
    shown = {"name": "Company Name", "website": "Website", "email": "Email", "phone": "Phone", "category": "Category", "lead_quality": "Lead Quality", "keyword_match_pct": "Keyword Match %"} | (headers or {})
    return contacts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in shown.items()])


def write_contacts(contacts: DataFrame, path: str, headers: dict | None = None) -> None:
    contact_export(contacts, headers).write.csv(path, header=True)

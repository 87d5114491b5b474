"""Contacts, names and relevance of leads from stored company pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.config import LeadConfig
from leadloom.functions import company, contacts, tokens
from leadloom.operators.lookup import merge_later_wins, without

QUALITIES = ["HOT", "WARM", "COLD", "NOISE"]


def visit_key(url: Column) -> Column:
    """What addresses of one page share: no scheme, www., query, fragment or closing slash."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z]+://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), "/+$", "")


def visit_plan(targets: DataFrame, config: LeadConfig | None = None, mode: str = "static", kept: list[str] | None = None) -> DataFrame:
    """target key, visit and page key, and kept columns of the target: the home page, then contact paths, as many as the mode allows."""
    config = config or LeadConfig()
    paths = ["", *config.contact_paths[: config.max_contact_paths.get(mode, len(config.contact_paths))]]
    base = F.regexp_replace("website", "/+$", "")
    planned = targets.select("key", base.alias("_base"), *(kept or []), F.posexplode(F.array(*map(F.lit, paths))))
    return planned.select("key", F.col("pos").alias("visit"), visit_key(F.concat("_base", "col")).alias("page_key"), *(kept or []))


def page_facts(pages: DataFrame, config: LeadConfig | None = None, kept: list[str] | None = None) -> DataFrame:
    """url, html, render_mode, status -> what is extracted from each page that loaded, and kept columns; pages themselves are never shuffled."""
    shown = pages.filter("status < 400")
    return shown.select(
        visit_key(F.col("url")).alias("page_key"), "render_mode", contacts.all_emails(F.col("html"), config).alias("emails"), contacts.phones(F.col("html")).alias("phones"),
        company.company_name(F.col("html"), F.lit(None).cast("string")).alias("page_name"), tokens.page_text(F.col("html")).alias("body"), *(kept or []),
    )


def until_good(visits: DataFrame, config: LeadConfig | None = None, site: str = "key") -> DataFrame:
    """Visits up to the first whose page has an email scored 2 or better."""
    good = F.exists("emails", lambda e: contacts.email_score(e, config) <= 2)
    before = Window.partitionBy(site).orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)
    return visits.withColumn("_good", good).withColumn("_over", F.max("_good").over(before)).filter(~F.coalesce("_over", F.lit(False))).drop("_good", "_over")


def site_contacts(visits: DataFrame, config: LeadConfig | None = None, site: str = "key") -> DataFrame:
    """One row a site: its best email (score, then visit, then text) and its first phone, by partial aggregates of small structs."""
    scored = F.transform("emails", lambda e: F.struct(contacts.email_score(e, config).alias("score"), F.col("visit").alias("visit"), F.lower(F.trim(e)).alias("email")))
    best = F.array_min(F.filter(scored, lambda s: s["score"] < 999))
    phone = F.when(F.size("phones") > 0, F.struct("visit", F.get("phones", F.lit(0)).alias("phone")))
    out = visits.select(site, best.alias("_email"), phone.alias("_phone"), F.when(F.col("visit") == 0, F.col("page_name")).alias("_name"))
    return out.groupBy(site).agg(F.min("_email")["email"].alias("email"), F.min("_phone")["phone"].alias("phone"), F.max("_name").alias("page_name"))


def extract_contacts(targets: DataFrame, facts: DataFrame, config: LeadConfig | None = None, mode: str = "static") -> DataFrame:
    """key, email, phone, page_name of each target of which a page of this mode is stored."""
    own = facts.filter(F.col("render_mode") == mode).select("page_key", "emails", "phones", "page_name")
    return site_contacts(until_good(visit_plan(targets, config, mode).join(own, "page_key"), config), config)


def relevance(body: Column, query: Column) -> dict[str, Column]:
    """Grade and its evidence for a page's text and the query that led to it."""
    match = tokens.keyword_match(body, query)
    contact, about, services, noise = (f(body) for f in (tokens.has_contact, tokens.has_about, tokens.has_services, tokens.is_noise))
    return {"lead_quality": tokens.grade(match, contact, about, services, noise), "keyword_match_pct": match, "has_contact": contact, "has_about": about, "is_noise": noise}


def site_results(targets: DataFrame, facts: DataFrame, config: LeadConfig | None = None) -> DataFrame:
    """key, email, phone, page_name, pass, lead_quality, keyword_match_pct of each target of which a page is stored.

    Static pages come first (pass 1); rendered ones count only for targets to which those give no contact (pass 2).
    Both passes and the grade of the home page come from one scan of the pages: visits of both modes are joined at once,
    and one aggregation by target keeps both passes' results apart.
    """
    config = config or LeadConfig()
    plans = [visit_plan(targets, config, m).withColumn("render_mode", F.lit(m)) for m in ("static", "rendered")]
    # only static pages are graded: others' text is neither worked out nor shuffled
    facts = facts.withColumn("body", F.when(F.col("render_mode") == "static", F.col("body")))
    visits = plans[0].unionByName(plans[1]).join(facts, ["page_key", "render_mode"])
    visits = visits.join(targets.select("key", "search_query"), "key")
    home = (F.col("visit") == 0) & (F.col("render_mode") == "static") & (F.col("search_query") != "")
    graded = F.when(home, F.struct(*[v.alias(k) for k, v in relevance(F.col("body"), F.col("search_query")).items()]))
    shown = visits.select("key", "visit", "render_mode", "emails", "phones", "page_name", graded.alias("grade"))
    good = F.exists("emails", lambda e: contacts.email_score(e, config) <= 2)
    before = Window.partitionBy("key", "render_mode").orderBy("visit").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("_good", good).withColumn("_live", ~F.coalesce(F.max("_good").over(before), F.lit(False)))
    scored = F.transform("emails", lambda e: F.struct(contacts.email_score(e, config).alias("score"), F.col("visit").alias("visit"), F.lower(F.trim(e)).alias("email")))
    parts = shown.select(
        "key", "render_mode", "grade", F.when(F.col("_live"), F.array_min(F.filter(scored, lambda s: s["score"] < 999))).alias("_email"),
        F.when(F.col("_live") & (F.size("phones") > 0), F.struct("visit", F.get("phones", F.lit(0)).alias("phone"))).alias("_phone"), F.when(F.col("visit") == 0, F.col("page_name")).alias("_name"),
    )
    of = lambda mode, c: F.when(F.col("render_mode") == mode, F.col(c))
    picked = parts.groupBy("key").agg(
        *[x for m in ("static", "rendered") for x in (F.min(of(m, "_email"))["email"].alias(f"{m}_email"), F.min(of(m, "_phone"))["phone"].alias(f"{m}_phone"), F.max(of(m, "_name")).alias(f"{m}_name"))],
        F.min(F.struct(F.col("grade.lead_quality").isNull().alias("none"), "grade")).alias("g"),
    )
    first = F.col("static_email").isNotNull() | F.col("static_phone").isNotNull()
    second = F.col("rendered_email").isNotNull() | F.col("rendered_phone").isNotNull()
    pick = lambda c: F.when(first, F.col(f"static_{c}")).when(second, F.col(f"rendered_{c}"))
    return picked.select(
        "key", pick("email").alias("email"), pick("phone").alias("phone"), pick("name").alias("page_name"), F.when(first, 1).when(second, 2).alias("pass"),
        F.col("g.grade.lead_quality").alias("lead_quality"), F.col("g.grade.keyword_match_pct").alias("keyword_match_pct"),
    )


def two_passes(targets: DataFrame, facts: DataFrame, config: LeadConfig | None = None) -> DataFrame:
    """Contacts from static pages; from rendered ones only for targets without any."""
    return site_results(targets, facts, config).filter("pass is not null").select("key", "email", "phone", "page_name", "pass")


def usable(leads: DataFrame) -> DataFrame:
    """Leads with a website that no directory flag rules out, as targets keyed by domain."""
    return leads.filter("website <> '' and not (flagged and flag_reason = 'directory')")


def enrich(targets: DataFrame, pages: DataFrame, config: LeadConfig | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Contacts of all targets (key, name, website, phone, category, search_query); earlier results fill what is missing.

    A target stays if an email or a phone was found or it came with a phone.
    """
    todo = without(targets, earlier, ["key"]) if earlier is not None else targets
    out = with_found(todo, site_results(todo, page_facts(pages, config), config).withColumnRenamed("phone", "_found"))
    return merge_later_wins(earlier, out, "key") if earlier is not None else out


def with_found(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Targets with what was found (key, email, _found, page_name, lead_quality, keyword_match_pct), if that or the target has an email or a phone."""
    out = targets.join(found, "key", "left").select(
        "key", F.coalesce("page_name", "name").alias("name"), "website", "email", F.coalesce("_found", F.nullif("phone", F.lit(""))).alias("phone"), "category", "lead_quality", "keyword_match_pct"
    )
    return out.filter("email is not null or phone is not null")


def last_by_name(contacts_table: DataFrame, position: str = "input_pos") -> DataFrame:
    """One row for each name key, the last in input order."""
    rest = [c for c in contacts_table.columns if c != "name"]
    out = contacts_table.groupBy(company.contact_key(F.col("name")).alias("name_key")).agg(F.max_by(F.struct("name", *rest), F.col(position)).alias("r"))
    return out.select("name_key", "r.*")


def by_quality(df: DataFrame) -> list[Column]:
    """An order: best quality first, then score."""
    return [F.array_position(F.array(*map(F.lit, QUALITIES)), F.coalesce("lead_quality", F.lit("NOISE"))), F.desc("score")]

"""Emails and phones in pages. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import config as fixed
from leadloom.config import LeadConfig
from leadloom.functions.entities import decode_entities, let
from leadloom.functions.urls import contains_any

# Patterns.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
WHOLE_EMAIL = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"
CODED = [r"/cdn-cgi/l/email-protection#([a-f0-9]+)", r'data-cfemail="([a-f0-9]+)"']


def plain_emails(html: Column, config: LeadConfig | None = None) -> Column:
    """Distinct emails in lower case, in order of appearance, without placeholders, asset names and very long ones."""
    config = config or LeadConfig()
    found = F.transform(F.regexp_extract_all(html, F.lit(EMAIL), 0), lambda e: F.regexp_replace(F.lower(e), "^[.,;\"']+|[.,;\"']+$", ""))

    def good(e: Column) -> Column:
        local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
        return e.rlike(WHOLE_EMAIL) & ~domain.isin(config.placeholder_domains) & ~local.isin(fixed.PLACEHOLDER_LOCALS) & ~contains_any(e, fixed.ASSET_EXTENSIONS) & (F.length(e) <= 80)

    return F.array_distinct(F.filter(found, good))


def decode_email(code: Column) -> Column:
    """An email from hexadecimal text whose first byte is the key of all others; anything else gives an empty text."""
    byte = lambda at: F.conv(F.substring(code, at, 2), 16, 10).cast("int")
    letters = F.transform(F.sequence(F.lit(3), F.length(code) - 1, F.lit(2)), lambda i: F.char(F.conv(code.substr(i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(byte(1))))
    return F.when((F.length(code) >= 4) & (F.length(code) % 2 == 0) & code.rlike("^[0-9a-fA-F]+$"), F.array_join(letters, "")).otherwise("")


def coded_emails(html: Column) -> Column:
    """Emails behind the two carriers of XOR-coded addresses, without query and fragment."""
    codes = F.concat(*[F.regexp_extract_all(html, F.lit(p), 1) for p in CODED])
    found = F.filter(F.transform(codes, decode_email), lambda e: e.contains("@"))
    return F.array_distinct(F.transform(found, lambda e: F.trim(F.lower(F.regexp_replace(e, "[?#].*$", "")))))


def all_emails(html: Column, config: LeadConfig | None = None) -> Column:
    return F.array_union(plain_emails(html, config), coded_emails(html))


def valid_phones(raw: Column) -> Column:
    """Of an array of candidates the valid ones, the first of those with equal digits: no decimal point, no three zeros in a row, 7 to 15 digits."""
    pairs = F.transform(raw, lambda r: F.struct(F.trim(r).alias("raw"), F.regexp_replace(r, "[^0-9]", "").alias("digits")))
    good = F.filter(pairs, lambda p: ~p["raw"].rlike(r"\.[0-9]") & ~p["digits"].contains("000") & F.length(p["digits"]).between(7, 15))
    # the first of equal digits: next to each other in order of digits and place, then back in order of place
    placed = F.array_sort(F.transform(good, lambda p, i: F.struct(p["digits"].alias("digits"), i.alias("place"), p["raw"].alias("raw"))))
    first = let(placed, lambda all_: F.filter(all_, lambda p, i: (i == 0) | (p["digits"] != F.get(all_, i - 1)["digits"])))
    return F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["place"].alias("place"), p["raw"].alias("raw")))), lambda p: p["raw"])


def phones(html: Column) -> Column:
    """Phones from tel: links, or if none is valid, from three patterns in turn."""
    linked = lambda text: F.transform(F.regexp_extract_all(text, F.lit("(?i)href=[\"'`]tel:([^\"'`]{4,25})[\"'`]"), 1), lambda p: F.replace(p, F.lit("%20"), F.lit(" ")))
    swept = lambda text: F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in fixed.PHONE_PATTERNS])
    either = lambda text: let(valid_phones(linked(text)), lambda sure: F.when(F.size(sure) > 0, sure).otherwise(valid_phones(swept(text))))
    return let(F.translate(decode_entities(html), "\u00a0", " "), either)


def email_score(email: Column, config: LeadConfig | None = None) -> Column:
    """1 personal, 2 a general address worth most, 3 another general one, 999 none or junk."""
    config = config or LeadConfig()
    low = F.lower(email)
    local, domain = F.substring_index(low, "@", 1), F.regexp_replace(low, "^[^@]*@", "")
    return (
        F.when(F.coalesce(~email.contains("@"), F.lit(True)), 999)
        .when(contains_any(local, config.skip_email_keywords) | contains_any(domain, config.junk_email_domains), 999)
        .when(~contains_any(local, config.generic_email_keywords), 1)
        .when(local.isin(fixed.PRIORITY_LOCALS), 2)
        .otherwise(3)
    )


def best_email(emails: Column, config: LeadConfig | None = None) -> Column:
    """The email with the least score below 999; of equal ones the first in the alphabet. Null if there is none."""
    scored = F.transform(emails, lambda e: F.struct(email_score(e, config).alias("score"), F.lower(F.trim(e)).alias("email")))
    return F.array_min(F.filter(scored, lambda s: s["score"] < 999))["email"]

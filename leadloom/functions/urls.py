"""Addresses: normal form, domain, root, name, checks and scores. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import config as fixed
from leadloom.functions.entities import let

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def contains_any(text: Column, words: list[str]) -> Column:
    """True if one of the words occurs in the text, as it is."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def form_decoded(value: Column) -> Column:
    """Percent and plus decoding; text that isn't validly encoded stays."""
    return F.coalesce(F.try_url_decode(value), value)


def percent_decoded(value: Column) -> Column:
    """Percent decoding that leaves a plus alone."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def form_encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalise_url(url: Column) -> Column:
    """https for //x; null without http(s); tracking and blank parameters and the fragment go, the host is lower case, no slash ends the path."""
    full = lambda t: F.when(t.rlike("^https?://"), t).when(t.startswith("//"), F.concat(F.lit("https:"), t))
    return let(let(F.regexp_replace(url, r"^\s+|\s+$", ""), full), _normal)


def _normal(full: Column) -> Column:
    bare = F.regexp_replace(path(full), "/+$", "")
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.regexp_replace(p, "^[^=]*=?", "")
    kept = F.filter(F.split(query(full), "&"), lambda p: (value(p) != "") & ~F.lower(form_decoded(name(p))).isin(fixed.TRACKING_PARAMS))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(form_encoded(form_decoded(name(p))), F.lit("="), form_encoded(form_decoded(value(p))))), "&")
    return F.concat(scheme(full), F.lit("://"), F.lower(host(full)), F.when(bare == "", F.lit("/")).otherwise(bare), F.when(encoded == "", F.lit("")).otherwise(F.concat(F.lit("?"), encoded)))


def base_domain(url: Column) -> Column:
    """The host in lower case without www. and port."""
    return F.substring_index(F.regexp_replace(F.lower(host(url)), r"^www\.", ""), ":", 1)


def segments(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def site_root(url: Column, domain: Column | None = None, keep_full: list[str] = ()) -> Column:
    """The site's root for an address with a path; others, and those of kept domains, stay."""
    root = F.when(segments(url) >= 1, F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"))).otherwise(url)
    return F.when(domain.isin(list(keep_full)), url).otherwise(root) if keep_full else root


def name_from_domain(domain: Column) -> Column:
    """Words of the domain without www. and the longest known ending, split at case changes, hyphens and underscores, capitalised."""
    endings = "|".join(sorted((s[1:].replace(".", r"\.") for s in fixed.NAME_SUFFIXES), key=lambda s: (-len(s), s)))
    stem = F.regexp_replace(F.regexp_replace(domain, r"^(?i)www\.", ""), rf"(?i)\.({endings})$", "")
    split = F.regexp_replace(F.regexp_replace(stem, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z])([A-Z])", "$1 $2")
    words = F.initcap(F.trim(F.regexp_replace(split, r"[-_\s]+", " ")))
    return F.when(words == "", domain).otherwise(words)


def title_head(title: Column) -> Column:
    """The title up to its first bar, hyphen or dash."""
    return F.trim(F.element_at(F.split(F.coalesce(title, F.lit("")), r"\s*[|\-–—]\s*"), 1))


def is_ad(url: Column) -> Column:
    low = F.lower(url)
    return contains_any(low, fixed.AD_MARKS) | ((F.length(url) > 300) & contains_any(low, ["?ld=", "/aclick"]))


def is_parasite(domain: Column) -> Column:
    return domain.rlike(fixed.PARASITE_HOST)


def label_suffixes(domain: Column) -> Column:
    """The domain and all its parent domains."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_flag(url: Column, domain: Column) -> Column:
    """Why an address is suspicious, or an empty text."""
    odd = F.length(url) >= 300
    for p in fixed.SUSPICIOUS_PATTERNS:
        odd = odd | url.rlike(p)
    return F.when(odd, "pattern").when(F.size(F.split(domain, r"\.")) > 4, "deep-subdomain").otherwise("")


def url_score(url: Column, boost_keywords: list[str] = ()) -> Column:
    low = F.lower(url)
    boost = F.when(contains_any(low, list(boost_keywords)), 1).otherwise(0)
    return boost - F.when(segments(url) >= 3, 1).otherwise(0) - F.when(low.rlike(fixed.LISTICLE), 2).otherwise(0)


def unwrap_ru(href: Column) -> Column:
    """The target of a /RU=...  redirect, a direct address as it is, else an empty text; never the engine's own site."""
    target = percent_decoded(F.regexp_extract(href, "/RU=([^/]*)", 1))
    own = lambda c: c.contains("yahoo.com")
    return F.when(href.contains("/RU=") & target.startswith("http") & ~own(target), target).when(href.startswith("http") & ~own(href), href).otherwise("")


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null if there is none or it is blank."""
    found = F.filter(F.split(query(url), "&"), lambda p: p.startswith(f"{name}=") & (F.length(p) > len(name) + 1))
    return form_decoded(F.substring(F.get(found, F.lit(0)), len(name) + 2, 1 << 20))


def unwrap_uddg(url: Column) -> Column:
    """The target in uddg= or u=, which is encoded twice, or the address itself."""
    return F.coalesce(percent_decoded(parameter(url, "uddg")), percent_decoded(parameter(url, "u")), url)


def unwrap_u(href: Column) -> Column:
    """The target in u=a1<base64>, a direct address, or the target of /url?q=; else an empty text."""
    code = F.translate(F.regexp_replace(parameter(href, "u"), "^a1", ""), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    second = percent_decoded(F.regexp_extract(href, r"/url\?q=([^&]*)", 1))
    return (
        F.when(target.startswith("http"), target)
        .when(href.startswith("http") & ~href.contains("bing.com"), href)
        .when(href.contains("/url?q=") & second.startswith("http"), second)
        .otherwise("")
    )


def clean_title(raw: Column) -> Column:
    """The title without a trailing address, runs of blanks and breadcrumbs."""
    cut = F.trim(F.regexp_replace(raw, r"https?://\S.*$", ""))
    return F.trim(F.element_at(F.split(F.regexp_replace(cut, r"\s{2,}", " "), r"\s+[›»]\s+"), 1))


def foreign_share(text: Column) -> Column:
    """The share of characters beyond ASCII; 0 of an empty or missing text."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def is_english(title: Column, description: Column) -> Column:
    long = F.coalesce(F.length(description), F.lit(0)) > 50
    return ~(foreign_share(title) >= 0.30) & ~(long & ((foreign_share(description) >= 0.25) | contains_any(F.lower(F.coalesce(description, F.lit(""))), fixed.LOCALE_MARKS)))

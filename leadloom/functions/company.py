"""A company's name from its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import config as fixed
from leadloom.functions.entities import decode_entities, let


def contact_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def _inner(html: Column, tag: str) -> Column:
    """The text of the first such element, tags taken out, entities decoded; null if there is none."""
    raw = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(decode_entities(F.regexp_replace(raw, "<[^>]*>", "")), r"\s+", " ")), F.lit(""))


def _meta(html: Column, name: str) -> Column:
    """The content of a meta element with this property; null if there is none."""
    tag = F.regexp_extract(html, rf"(?is)<meta\s[^>]*property=[\"']{name}[\"'][^>]*>", 0)
    return F.nullif(F.trim(decode_entities(F.regexp_extract(tag, "(?is)content=[\"']([^\"']*)[\"']", 1))), F.lit(""))


def _stripped(title: Column, always: bool) -> Column:
    """The title without a known ending; without any tail if that leaves nothing or (always) changes nothing."""
    again = lambda once: (once == "") | (once == title) if always else once == ""
    bare = F.trim(F.regexp_replace(title, fixed.TITLE_TAIL, ""))
    return let(F.trim(F.regexp_replace(title, fixed.TITLE_ENDING, "")), lambda once: F.when(again(once), bare).otherwise(once))


def company_name(html: Column, fallback: Column) -> Column:
    """og:site_name, title, og:title or first heading, whichever comes first with a fitting length; else the fallback."""
    fits = lambda value, most: let(value, lambda c: F.when((F.length(c) > 2) & (F.length(c) <= most), c))
    site = let(_meta(html, "og:site_name"), lambda c: F.when(F.length(c) <= 100, c))
    title = fits(let(_inner(html, "title"), lambda t: _stripped(t, True)), 100)
    og = fits(let(_meta(html, "og:title"), lambda t: _stripped(t, False)), 100)
    return F.coalesce(site, title, og, fits(_inner(html, "h1"), 80), fallback)

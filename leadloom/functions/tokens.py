"""Keyword tokens and page relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import config as fixed
from leadloom.functions.entities import decode_entities


def keyword_tokens(text: Column) -> Column:
    """Distinct words of four letters a-z or more, without stop words; a word with any other character in it is none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_except(F.filter(words, lambda w: w.rlike("^[a-z]{4,}$")), F.array(*map(F.lit, fixed.STOP_WORDS)))


def unrelated(title: Column, query: Column) -> Column:
    """True if both have keyword tokens, but none in common."""
    a, b = keyword_tokens(title), keyword_tokens(query)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def page_text(html: Column) -> Column:
    """The page's visible text in lower case: no scripts, styles, comments and tags, entities decoded, single blanks."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<template[^>]*>.*?</template>", " ")
    plain = F.translate(decode_entities(F.regexp_replace(bare, r"<[^>]*>", " ")), "\u00a0", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def keyword_match(body: Column, query: Column) -> Column:
    """The percentage of the query's tokens that occur in the body, rounded half to even."""
    tokens = keyword_tokens(query)
    hits = F.size(F.filter(tokens, lambda t: F.contains(body, t)))
    return F.bround(F.lit(100.0) * hits / F.greatest(F.size(tokens), F.lit(1)), 0).cast("int")


def has_contact(body: Column) -> Column:
    return body.rlike(fixed.HAS_CONTACT)


def has_about(body: Column) -> Column:
    return body.rlike(fixed.HAS_ABOUT)


def has_services(body: Column) -> Column:
    return body.rlike(fixed.HAS_SERVICES)


def is_noise(body: Column) -> Column:
    return body.rlike(fixed.IS_JOB_BOARD) | body.rlike(fixed.IS_DIRECTORY) | body.rlike(fixed.IS_NEWS)


def grade(match: Column, contact: Column, about: Column, services: Column, noise: Column) -> Column:
    """HOT, WARM, COLD, or NOISE unless the evidence is strong."""
    strong = (match >= 40) & (contact | services)
    return F.when(noise & ~strong, "NOISE").when(strong, "HOT").when((match >= 20) | about, "WARM").otherwise("COLD")

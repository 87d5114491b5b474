"""The same expressions and inputs in DuckDB SQL, written apart from the Spark ones, to compare results with."""

from __future__ import annotations

from html.entities import html5

from leadloom import config as fixed
from leadloom.functions.contacts import CODED, EMAIL, WHOLE_EMAIL
from leadloom.functions.entities import BARE, BARE_PATTERN, NAMED, NUMBERS
from leadloom.plans.inputs import ADDITIONS, PATHS, QUERY_TEXTS, TEST_CONFIG

PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qs(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def array(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def part(url: str, k: int) -> str:
    return f"regexp_extract({url}, {q(PARTS)}, {k})"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join([f"contains({text}, {q(w)})" for w in words] or ["false"]) + ")"


def form_encoded(x: str) -> str:
    return f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"


def full_url(u: str) -> str:
    t = rf"regexp_replace({u}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN regexp_matches({t}, '^https?://') THEN {t} WHEN starts_with({t}, '//') THEN 'https:' || {t} END"


def normalise(full: str) -> str:
    """Of a column that holds full_url()."""
    name, value = "string_split(p, '=')[1]", "regexp_replace(p, '^[^=]*=?', '')"
    kept = f"list_filter(string_split({part(full, 4)}, '&'), lambda p: {value} <> '' AND lower({name}) NOT IN {qs(fixed.TRACKING_PARAMS)})"
    encoded = f"array_to_string(list_transform({kept}, lambda p: {form_encoded(name)} || '=' || {form_encoded(value)}), '&')"
    bare = f"regexp_replace({part(full, 3)}, '/+$', '')"
    return f"lower({part(full, 1)}) || '://' || lower({part(full, 2)}) || CASE WHEN {bare} = '' THEN '/' ELSE {bare} END || CASE WHEN coalesce({encoded}, '') = '' THEN '' ELSE '?' || {encoded} END"


def domain(url: str) -> str:
    return rf"string_split(regexp_replace(lower({part(url, 2)}), '^www\.', ''), ':')[1]"


def segments(url: str) -> str:
    return f"len(list_filter(string_split({part(url, 3)}, '/'), lambda s: s <> ''))"


def root(url: str) -> str:
    return f"CASE WHEN {segments(url)} >= 1 THEN {part(url, 1)} || '://' || {part(url, 2)} || '/' ELSE {url} END"


def name_from_domain(d: str) -> str:
    endings = "|".join(sorted((s[1:].replace(".", r"\.") for s in fixed.NAME_SUFFIXES), key=lambda s: (-len(s), s)))
    stem = rf"regexp_replace(regexp_replace({d}, '(?i)^www\.', ''), '(?i)\.({endings})$', '')"
    split = rf"regexp_replace(regexp_replace({stem}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')"
    words = rf"array_to_string(list_transform(string_split(trim(regexp_replace({split}, '[-_\s]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    return f"CASE WHEN {words} = '' THEN {d} ELSE {words} END"


def tokens(text: str) -> str:
    words = rf"string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_]+')"
    return f"list_distinct(list_filter({words}, lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN {qs(fixed.STOP_WORDS)}))"


def title_head(t: str) -> str:
    return rf"trim(string_split_regex(coalesce({t}, ''), '\s*[|\-–—]\s*')[1])"


def unrelated(a: str, b: str) -> str:
    return f"(len({tokens(a)}) > 0 AND len({tokens(b)}) > 0 AND NOT list_has_any({tokens(a)}, {tokens(b)}))"


def is_ad(u: str) -> str:
    return f"({any_of(f'lower({u})', fixed.AD_MARKS)} OR (length({u}) > 300 AND {any_of(f'lower({u})', ['?ld=', '/aclick'])}))"


def url_flag(u: str, d: str) -> str:
    odd = " OR ".join([f"length({u}) >= 300", *(f"regexp_matches({u}, {q(p)})" for p in fixed.SUSPICIOUS_PATTERNS)])
    return f"CASE WHEN {odd} THEN 'pattern' WHEN len(string_split({d}, '.')) > 4 THEN 'deep-subdomain' ELSE '' END"


def url_score(u: str, boost: list[str]) -> str:
    low = f"lower({u})"
    return f"(CASE WHEN {any_of(low, boost)} THEN 1 ELSE 0 END - CASE WHEN {segments(u)} >= 3 THEN 1 ELSE 0 END - CASE WHEN regexp_matches({low}, {q(fixed.LISTICLE)}) THEN 2 ELSE 0 END)"


def suffix_listed(d: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"{d} = {q(w)} OR ends_with({d}, {q('.' + w)})" for w in words) + ")"


def rank(engine: str) -> str:
    return f"list_position({array(fixed.ENGINES)}, {engine})"


def entities(x: str, names: dict[str, str] = NAMED) -> str:
    """Named references (with `names` alone where the text has no others) and all numeric ones."""
    table = lambda d: "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"
    hexa, deci = "ltrim(regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1), '0')", "ltrim(regexp_extract(p, '^#([0-9]+)', 1), '0')"
    code = (
        f"CASE WHEN regexp_matches(p, '^#[0-9]') THEN CASE WHEN length({deci}) > 7 THEN 1114112 ELSE ('0' || {deci})::INTEGER END "
        f"WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]') THEN CASE WHEN length({hexa}) > 6 THEN 1114112 ELSE ('0x0' || {hexa})::INTEGER END END"
    )
    never = "c BETWEEN 1 AND 8 OR c = 11 OR c BETWEEN 14 AND 31 OR c = 127 OR c BETWEEN 64976 AND 65007 OR c & 65534 = 65534"
    odd = "map {" + ", ".join(f"{k}: chr({ord(v)})" for k, v in NUMBERS.items()) + "}"
    char = f"CASE WHEN c < 160 AND {odd}[c] IS NOT NULL THEN {odd}[c] WHEN c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr(65533) WHEN {never} THEN '' ELSE chr(c) END"
    number = f"list_transform([{code}], lambda c: CASE WHEN c IS NULL THEN '&' || p ELSE {char} || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') END)[1]"
    short = f"CASE WHEN regexp_matches(p, {q(BARE_PATTERN)}) THEN {table({k: html5[k] for k in BARE})}[regexp_extract(p, {q(BARE_PATTERN)}, 1)] || regexp_replace(p, {q(BARE_PATTERN)}, '') ELSE '&' || p END" if names is not NAMED else "'&' || p"
    name = "regexp_extract(p, '^([A-Za-z0-9]{1,31});', 1)"
    named = f"CASE WHEN {table(names)}[{name}] IS NOT NULL THEN {table(names)}[{name}] || regexp_replace(p, '^[^;]*;', '') ELSE {short} END"
    rest = f"array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: CASE WHEN starts_with(p, '#') THEN {number} ELSE {named} END), '')"
    return f"CASE WHEN contains({x}, '&') THEN string_split({x}, '&')[1] || {rest} ELSE {x} END"


def page_text(html: str) -> str:
    bare = rf"regexp_replace({html}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<template[^>]*>.*?</template>', ' ', 'g')"
    plain = f"replace({entities(f'regexp_replace({bare}, {q("<[^>]*>")}, {q(" ")}, {q("g")})')}, chr(160), ' ')"
    return rf"lower(trim(regexp_replace({plain}, '\s+', ' ', 'g')))"


def keyword_match(body: str, query: str) -> str:
    t = tokens(query)
    return f"round_even(100.0 * len(list_filter({t}, lambda t: contains({body}, t))) / greatest(len({t}), 1), 0)::INTEGER"


def grade(match: str, contact: str, about: str, services: str, noise: str) -> str:
    strong = f"({match} >= 40 AND ({contact} OR {services}))"
    return f"CASE WHEN {noise} AND NOT {strong} THEN 'NOISE' WHEN {strong} THEN 'HOT' WHEN {match} >= 20 OR {about} THEN 'WARM' ELSE 'COLD' END"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def noise(body: str) -> str:
    return "(" + " OR ".join(matches(body, p) for p in (fixed.IS_JOB_BOARD, fixed.IS_DIRECTORY, fixed.IS_NEWS)) + ")"


def plain_emails(html: str) -> str:
    found = f"list_transform(regexp_extract_all({html}, {q(EMAIL)}), lambda e: regexp_replace(lower(e), {q('^[.,;"' + chr(39) + ']+|[.,;"' + chr(39) + ']+$')}, '', 'g'))"
    good = f"regexp_matches(e, {q(WHOLE_EMAIL)}) AND string_split(e, '@')[-1] NOT IN {qs(TEST_CONFIG.placeholder_domains)} AND string_split(e, '@')[1] NOT IN {qs(fixed.PLACEHOLDER_LOCALS)} AND NOT {any_of('e', fixed.ASSET_EXTENSIONS)} AND length(e) <= 80"
    return f"list_distinct(list_filter({found}, lambda e: {good}))"


def coded_emails(html: str) -> str:
    codes = "list_concat(" + ", ".join(f"regexp_extract_all({html}, {q(p)}, 1)" for p in CODED) + ")"
    letters = "array_to_string(list_transform(range(3, length(c), 2), lambda i: chr(xor(('0x' || substr(c, i, 2))::INTEGER, ('0x' || substr(c, 1, 2))::INTEGER))), '')"
    decoded = f"list_transform({codes}, lambda c: CASE WHEN length(c) >= 4 AND length(c) % 2 = 0 THEN {letters} ELSE '' END)"
    return f"list_distinct(list_transform(list_filter({decoded}, lambda e: contains(e, '@')), lambda e: trim(lower(regexp_replace(e, '[?#].*$', '')))))"


def all_emails(html: str) -> str:
    return f"list_distinct(list_concat({plain_emails(html)}, {coded_emails(html)}))"


def valid_phones(raw: str) -> str:
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    good = rf"list_filter(list_transform({raw}, lambda r: trim(r)), lambda r: NOT regexp_matches(r, '\.[0-9]') AND NOT contains({digits('r')}, '000') AND length({digits('r')}) BETWEEN 7 AND 15)"
    return f"list_filter({good}, lambda r, i: list_position(list_transform({good}, lambda x: {digits('x')}), {digits('r')}) = i)"


def phones(text: str) -> str:
    """Of a column that holds the page with its entities decoded."""
    pattern = q("(?i)href=[\"'`]tel:([^\"'`]{4,25})[\"'`]")
    linked = valid_phones(f"list_transform(regexp_extract_all({text}, {pattern}, 1), lambda p: replace(p, '%20', ' '))")
    swept = valid_phones(f"list_concat(list_concat({', '.join(f'regexp_extract_all({text}, {q(p)})' for p in fixed.PHONE_PATTERNS[:2])}), regexp_extract_all({text}, {q(fixed.PHONE_PATTERNS[2])}))")
    return f"CASE WHEN len({linked}) > 0 THEN {linked} ELSE {swept} END"


def email_score(e: str) -> str:
    local, host = f"string_split({e}, '@')[1]", f"regexp_replace({e}, '^[^@]*@', '')"
    return f"CASE WHEN NOT contains({e}, '@') OR {any_of(local, TEST_CONFIG.skip_email_keywords)} OR {any_of(host, TEST_CONFIG.junk_email_domains)} THEN 999 WHEN NOT {any_of(local, TEST_CONFIG.generic_email_keywords)} THEN 1 WHEN {local} IN {qs(fixed.PRIORITY_LOCALS)} THEN 2 ELSE 3 END"


def inner(html: str, tag: str) -> str:
    raw = q(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>")
    bare = f"regexp_replace(regexp_extract({html}, {raw}, 1), '<[^>]*>', '', 'g')"
    return rf"nullif(trim(regexp_replace({entities(bare)}, '\s+', ' ', 'g')), '')"


def meta(html: str, name: str) -> str:
    tag = f"regexp_extract({html}, {q(rf'''(?is)<meta\s[^>]*property=["']{name}["'][^>]*>''')}, 0)"
    content = f"regexp_extract({tag}, {q('''(?is)content=["']([^"']*)["']''')}, 1)"
    return f"nullif(trim({entities(content)}), '')"


def stripped(title: str, always: bool) -> str:
    once = f"trim(regexp_replace({title}, {q(fixed.TITLE_ENDING)}, ''))"
    again = f"({once} = '' OR {once} = {title})" if always else f"{once} = ''"
    return f"CASE WHEN {again} THEN trim(regexp_replace({title}, {q(fixed.TITLE_TAIL)}, '')) ELSE {once} END"


def fits(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > 2 AND length({x}) <= {most} THEN {x} END"


# Inputs.
RAW = f"""raw AS (
  SELECT {array(fixed.ENGINES)}[page_id % 4 + 1] AS engine, page_id % 3 AS query_idx, {array(QUERY_TEXTS)}[page_id % 3 + 1] AS query,
         (page_id // 12 % 5 + 1)::INTEGER AS page_no, page_id AS position, url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<p>([^<]*)</p>', 1) AS snippet
  FROM pages
)"""
VARIANTS = f"""{RAW}, variants AS (
  SELECT * EXCLUDE (url), CASE position % 9
    WHEN 1 THEN 'https://www.bing.com/aclick?ld=' || position
    WHEN 2 THEN replace(url, '://', '://a.b.c.')
    WHEN 3 THEN 'https://best-' || position || '.example.com/top-10/x/y/z'
    WHEN 4 THEN 'https://shop.com.seo.net/about'
    WHEN 5 THEN 'https://www.yell.com/biz/' || position
    WHEN 6 THEN ' https://firm' || position || '.co.uk/search?q=a%20b+c&utm_source=x&b=&C=%C3%A9#top'
    WHEN 7 THEN '//WWW.Blog.Upper' || position || '.org:8080/News//'
    WHEN 8 THEN 'ftp://files' || position || '.org/'
    ELSE url END AS url
  FROM raw
)"""
PAGES = f"page_variants AS (SELECT page_id, url, html || {array(ADDITIONS)}[page_id % {len(ADDITIONS)} + 1] AS html FROM pages)"


def cleaned(source: str) -> str:
    """CTEs from raw or variants to leads, as clean_results makes them."""
    c = TEST_CONFIG
    return f"""f AS (SELECT *, {full_url("url")} AS full_url FROM {source} WHERE NOT {is_ad("url")}),
n AS (SELECT *, {normalise("full_url")} AS url_norm FROM f WHERE full_url IS NOT NULL),
d AS (SELECT *, {domain("url_norm")} AS domain FROM n),
x AS (SELECT * FROM d WHERE domain <> '' AND domain NOT IN {qs(c.excluded_exact)} AND NOT {suffix_listed("domain", c.excluded_suffix)} AND NOT regexp_matches(domain, {q(fixed.PARASITE_HOST)})),
w AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {rank("engine")}, query_idx, page_no, position) AS place FROM x),
r AS (SELECT *, {root("url_norm")} AS website_url FROM w WHERE place = 1),
a AS (SELECT *, {url_flag("website_url", "domain")} AS reason0, {url_score("website_url", c.boost_keywords)} AS score0,
      string_split(domain, '.')[-1] IN {qs(c.geo_suspect_tlds)} AS geo, {unrelated(title_head("title"), "query")} AS far FROM r),
b AS (SELECT *, CASE WHEN geo THEN 'geo-suspect' ELSE reason0 END AS reason1 FROM a),
leads AS (SELECT {name_from_domain("domain")} AS company_name, website_url, domain, query AS search_query, engine AS search_engine,
  (reason1 <> '' OR far) AS flagged, CASE WHEN far AND reason1 = '' THEN 'irrelevant' ELSE reason1 END AS flag_reason,
  (CASE WHEN far THEN -5 ELSE score0 - CASE WHEN geo THEN 2 ELSE 0 END END)::INTEGER AS score, query_idx, page_no, position FROM b)"""


SITES = f"""{PAGES}, sp AS (SELECT *, {domain("url")} AS domain FROM page_variants),
sv AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1 AS visit FROM sp),
site_pages AS (SELECT page_id, domain, visit, CASE WHEN visit < {len(PATHS)} THEN 'https://' || domain || {array(PATHS)}[least(visit, {len(PATHS) - 1}) + 1] ELSE url END AS url,
  html, CASE WHEN page_id % 5 = 4 THEN 'rendered' ELSE 'static' END AS render_mode, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status FROM sv),
targets AS (SELECT key, {name_from_domain("key")} AS name, 'https://' || key || '/' AS website, CASE WHEN length(key) % 4 = 0 THEN '+1 (555) 010-9999' ELSE '' END AS phone,
  'c' || length(key) % 3 AS category, {array(QUERY_TEXTS)}[length(key) % 3 + 1] AS search_query, input_pos
  FROM (SELECT {domain("url")} AS key, min(page_id) AS input_pos FROM pages GROUP BY 1))"""


def visit_key(u: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({u}), '^[a-z]+://(www\.)?', ''), '[?#].*$', ''), '/+$', '')"


FACTS = f"""{SITES}, decoded AS (SELECT *, replace({entities("html")}, chr(160), ' ') AS plain FROM site_pages WHERE status < 400),
facts AS (SELECT {visit_key("url")} AS page_key, render_mode, {all_emails("html")} AS emails, {phones("plain")} AS phones,
  coalesce(CASE WHEN length({meta("html", "og:site_name")}) <= 100 THEN {meta("html", "og:site_name")} END, {fits(stripped(inner("html", "title"), True), 100)},
           {fits(stripped(meta("html", "og:title"), False), 100)}, {fits(inner("html", "h1"), 80)}) AS page_name,
  {page_text("html")} AS body FROM decoded)"""


def extracted(name: str, targets: str, mode: str) -> str:
    """CTEs of the contacts that pages of one mode give to targets."""
    n = 1 + TEST_CONFIG.max_contact_paths[mode]
    return f"""{name}_v AS (SELECT t.key, v.visit, f.emails, f.phones, f.page_name,
  len(list_filter(f.emails, lambda e: {email_score("e")} <= 2)) > 0 AS good
  FROM {targets} t, (SELECT unnest(range(0, {n})) AS visit) v, facts f
  WHERE f.render_mode = '{mode}' AND f.page_key = {visit_key(f"regexp_replace(t.website, '/+$', '') || {array(PATHS)}[v.visit + 1]")}),
{name}_o AS (SELECT *, max(good) OVER (PARTITION BY key ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM {name}_v),
{name}_u AS (SELECT * FROM {name}_o WHERE NOT coalesce(over, false)),
{name}_e AS (SELECT key, min(struct_pack(score := {email_score("lower(trim(e))")}, visit := visit, email := lower(trim(e)))) AS best
  FROM (SELECT key, visit, unnest(emails) AS e FROM {name}_u) WHERE {email_score("lower(trim(e))")} < 999 GROUP BY key),
{name} AS (SELECT u.key, any_value(e.best.email) AS email, arg_min(u.phones[1], u.visit) FILTER (WHERE len(u.phones) > 0) AS phone, max(CASE WHEN u.visit = 0 THEN u.page_name END) AS page_name
  FROM {name}_u u LEFT JOIN {name}_e e ON e.key = u.key GROUP BY u.key)"""


PASSES = f"""{FACTS}, {extracted("first", "targets", "static")}, done AS (SELECT *, 1 AS pass FROM first WHERE email IS NOT NULL OR phone IS NOT NULL),
rest AS (SELECT * FROM targets WHERE key NOT IN (SELECT key FROM done)), {extracted("second", "rest", "rendered")},
passes AS (SELECT * FROM done UNION ALL SELECT *, 2 AS pass FROM second WHERE email IS NOT NULL OR phone IS NOT NULL)"""
SIGNALS = {"has_contact": fixed.HAS_CONTACT, "has_about": fixed.HAS_ABOUT, "has_services": fixed.HAS_SERVICES}
GRADED = f"""{PASSES}, graded AS (SELECT key, min(quality) AS lead_quality, min(match) AS keyword_match_pct FROM (
  SELECT key, match, {grade("match", *[matches("body", p) for p in SIGNALS.values()], noise("body"))} AS quality FROM (
    SELECT t.key, f.body, {keyword_match("f.body", "t.search_query")} AS match FROM targets t JOIN facts f ON f.render_mode = 'static' AND f.page_key = {visit_key("t.website")} WHERE t.search_query <> '')) GROUP BY key),
enriched AS (SELECT t.key, coalesce(p.page_name, t.name) AS name, t.website, p.email, coalesce(p.phone, nullif(t.phone, '')) AS phone, t.category, g.lead_quality, g.keyword_match_pct
  FROM targets t LEFT JOIN passes p ON p.key = t.key LEFT JOIN graded g ON g.key = t.key WHERE p.email IS NOT NULL OR coalesce(p.phone, nullif(t.phone, '')) IS NOT NULL)"""
LOG = f"""log AS (SELECT engine, (attempt - 1) // 10 AS query_idx, attempt, http_status FROM (
  SELECT {array(fixed.ENGINES)}[event_id % 4 + 1] AS engine, CASE WHEN event_type = 'error' THEN 429 WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN 500 ELSE 200 END AS http_status,
         row_number() OVER (PARTITION BY event_id % 4 ORDER BY ts, event_id) AS attempt FROM events))"""

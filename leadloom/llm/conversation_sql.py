"""DuckDB SQL for the queries on conversations. It has no crc32, so that is worked out bit by bit."""

from __future__ import annotations

#: The reflected polynomial of CRC-32, and all ones.
POLYNOMIAL, ONES = 0xEDB88320, 0xFFFFFFFF


def crc32(text: str) -> str:
    bits = f"list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, {POLYNOMIAL} * (x & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([{ONES}::BIGINT], {chars}), lambda a, b: {bits}), {ONES})"


TRIE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32("conv_id::VARCHAR")} % 9 AS h FROM t WHERE pos = 1
), r AS (
  SELECT c.conv_id, t.pos, 0 AS part, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= h
  UNION ALL SELECT c.conv_id, t.pos, 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, string_agg(md5(role) || md5(text), '/') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM s
), n AS (
  SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM e GROUP BY path
), k AS (
  SELECT n.*, coalesce(q.kids, 0) AS kids FROM n LEFT JOIN (SELECT parent, count(*) AS kids FROM n GROUP BY parent) q ON q.parent = n.path
), u AS (
  SELECT e.path, sum((k.kids = 0)::BIGINT) AS n_leaves, sum((k.n_convs - 1) * k.bytes) AS saved_tokens
  FROM k JOIN e ON e.conv_id = k.conv_id AND e.depth <= k.depth GROUP BY e.path
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.kids AS n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN u ON u.path = k.path LEFT JOIN k p ON p.path = k.parent
"""


def _plus(value: str, cost: str, letter: str) -> str:
    """A value is nine digits of cost and the audit; the least string is the cheapest, then the first audit."""
    return f"lpad((substr({value}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10)"


#: Where user and assistant lead from each state (nothing yet, after system, after user, after assistant).
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_NEVER = "'900000000'"


def _row_moves(s: int) -> str:
    """The least value of state s before a row, from the values g.w0 .. g.w3 after it."""
    role, to = _NEXT[s]
    more = "CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END"
    may = "r.fault NOT IN ('blank', 'duplicate')"
    system = f"CASE WHEN {may} AND r.initial = 's' THEN {_plus('g.w1', more, 'K')} END, " if s == 0 else ""
    return f"least({_plus(f'g.w{s}', '2', 'D')}, {system}CASE WHEN {may} AND r.initial = '{role}' THEN {_plus(f'g.w{to}', more, 'K')} END, CASE WHEN {may} THEN {_plus(f'g.w{to}', f'1 + {more}', 'R')} END)"


def _inserted(s: int, depth: int = 2) -> str:
    """v{s}, or cheaper after one or more insertions."""
    to = _NEXT[s][1]
    return f"v{s}" if depth == 0 else f"least(v{s}, {_plus(f'({_inserted(to, depth - 1)})', '5', 'I')})"


REPAIR = f"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM spaced WHERE fate <> 0
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS row FROM d
), r AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY row) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM m
), q AS (
  SELECT *, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY row) AS pair FROM r
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM q GROUP BY conv_id
), g AS (
  SELECT conv_id, n AS i, {", ".join(f"{_inserted(s)} AS w{s}" for s in range(4))}
  FROM found, (SELECT '000000000' AS v0, {_NEVER} AS v1, {_NEVER} AS v2, '000000000' AS v3)
  UNION ALL
  SELECT conv_id, i, {", ".join(f"{_inserted(s)} AS w{s}" for s in range(4))}
  FROM (SELECT g.conv_id, g.i - 1 AS i, {", ".join(f"{_row_moves(s)} AS v{s}" for s in range(4))}
        FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.row = g.i - 1)
), best AS (
  SELECT conv_id, substr(w0, 1, 9)::BIGINT AS cost, substr(w0, 10) AS audit FROM g WHERE i = 0
), l AS (
  SELECT conv_id, place, substr(audit, place::INTEGER, 1) AS letter FROM best, unnest(range(1, length(audit) + 1)) AS x(place)
), placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY place) - 1 AS row FROM l
), kept AS (
  SELECT placed.conv_id, place, letter, r.role, r.text, r.initial, row_number() OVER (PARTITION BY placed.conv_id ORDER BY place) AS p
  FROM placed LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM placed.conv_id AND r.row = placed.row AND letter <> 'I' WHERE letter <> 'D'
), roles AS (
  SELECT *, p - max((p = 1 AND letter = 'K' AND initial = 's')::INTEGER) OVER (PARTITION BY conv_id) AS turn_no FROM kept
), hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN turn_no % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS h
  FROM roles GROUP BY conv_id
)
SELECT c.conv_id, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN hashes ON hashes.conv_id IS NOT DISTINCT FROM c.conv_id
"""

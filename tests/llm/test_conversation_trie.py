import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from leadloom.llm import conversation_trie as ct
from leadloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, prefix int, bytes double"


def table(spark, rows):
    """rows of (conv_id, turn, role, text), with columns whose names the operator uses too."""
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(3)


def expected(paths):
    """Every prefix of the paths {conv_id: [(role, text)]}, by dictionaries of whole prefixes."""
    members, ends = defaultdict(set), defaultdict(set)
    for c, p in paths.items():
        ends[tuple(p)].add(c)
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = set()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        joined = ",".join(map(str, sorted(ends[p])))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(joined.encode()).hexdigest()))
    return out


def ordered(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}


def rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def got(df):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]


def made(seed, n=60):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])) for c in range(n) for t in range(rng.randrange(1, 14))]


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations(spark, seed):
    rows = [r for r in made(seed) if r[0] % 11]  # some conversations are absent, bases among them
    out = got(ct.shared_prefixes(table(spark, rows)))
    assert len(out) == len(set(out)) and set(out) == expected(rebuilt(rows))


def test_turnless_when_the_base_is_absent(spark):
    c = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3)
    assert got(ct.shared_prefixes(table(spark, [(c, 0, "user", "a"), (c, 1, "user", "b")]))) == list(expected({c: []}))


def test_as_they_are(spark):
    rows = made(3) + [(None, 1, "user", "no conversation"), (7, None, "user", "first"), (-4, 0, "user", "a"), (-4, 0, "user", "a"), (-4, 1, None, None)]
    own = ordered(rows)
    out = got(ct.prefix_trie(table(spark, rows)))
    ties = {c for c in own if len({(c, r[1]) for r in rows if r[0] == c}) < len([r for r in rows if r[0] == c])}
    assert ties == {-4} and set(out) == expected(own)


def test_empty(spark):
    assert got(ct.prefix_trie(table(spark, []))) == [] == got(ct.shared_prefixes(table(spark, [])))


def test_copies_and_a_long_conversation(spark):
    """A third of all conversations are one, and one has 3,000 turns."""
    rows = [(c, t, "user", f"copy {t}") for c in range(300) for t in range(3)] + [(c, 0, "user", f"own {c % 7}") for c in range(300, 900)] + [(900, t, "user", f"{t % 17}") for t in range(3000)]
    out = {(r[0], r[1]): r for r in got(ct.prefix_trie(table(spark, rows)))}
    assert len(out) == 1 + 3 + 7 + 3000
    assert out[0, 3][3:6] == (300, 0, 1) and out[0, 3][7] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    assert out[0, 0][3:6] == (901, 9, 9) and out[0, 0][6] == 299 * 3 * 6 + sum(n - 1 for n in [86] * 5 + [85, 85]) * 5 and out[900, 3000][2] == 900


def test_handles():
    for a in range(70):
        for b in range(a + 1, 71):
            assert ct.handle(a, b) == max(range(a + 1, b + 1), key=lambda f: f & -f)


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_exit_nodes_of_batches(batch):
    """Whatever the batches, the trie has a node for each branching and each end, and finds the deepest one on every path."""
    rng = random.Random(batch)
    paths = [(c, [rng.choice("ab") for _ in range(rng.randrange(0, 40))]) for c in range(400)]
    paths += [(1000 + c, [*p[: len(p) // 2], *"ba" * rng.randrange(3)]) for c, p in paths]
    digests = {c: [ct.ROOT, *["".join(p[: d + 1]).encode() for d in range(len(p))]] for c, p in paths}
    trie = ct.ZFastTrie()
    for i in range(0, len(paths), batch):
        trie.insert([(c, digests[c]) for c, _ in paths[i : i + batch]])
    members = defaultdict(set)
    for c, d in digests.items():
        for x in d:
            members[x].add(c)
    assert {(d[e], least, n) for _, e, d, least, n in trie.edges()} >= {(digests[c][-1], min(members[digests[c][-1]]), len(members[digests[c][-1]])) for c in digests}
    expanded = {d[k]: (least, n) for a, e, d, least, n in trie.edges() for k in range(max(a + 1, 0), e + 1)}
    assert expanded == {x: (min(m), len(m)) for x, m in members.items()}
    for d in digests.values():
        assert trie.exit(d)[1] == len(d) - 1


def test_against_sql(spark):
    con, at = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"create view conversations as select * from '{at}/conversations.parquet'")
    out = queries.op11_conversation_trie(spark, at)
    want = con.execute(queries.ORACLE_SQL["op11_conversation_trie"]).fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))

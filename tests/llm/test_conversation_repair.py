import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from leadloom.llm import conversation_repair as cr
from leadloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, row string, fault int, place double"


def table(spark, rows):
    """rows of (conv_id, turn, role, text), with columns whose names the operator uses too."""
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(3)


def all_repairs(rows, costs, most_inserted):
    """(cost, audit, roles) of every way to repair rows (initial, fault) with at most so many insertions."""
    gaps = range(len(rows) + 1)
    inserts = [list(x) for n in range(most_inserted + 1) for x in itertools.combinations_with_replacement([(g, r) for g in gaps for r in "ua"], n)]
    inserts = {tuple(p) for x in inserts for p in itertools.permutations(x)} if most_inserted else {()}
    for edits in itertools.product(*[["D"] if fault in ("blank", "duplicate") else ["D", "Ru", "Ra", *(["K"] if initial else [])] for initial, fault in rows]):
        for extra in inserts:
            cost, audit, roles = costs.insert * len(extra), "", ""
            for i in gaps:
                for g, r in extra:
                    if g == i:
                        audit, roles = audit + "I", roles + r
                if i < len(rows):
                    e = edits[i]
                    audit += e[0]
                    roles += "" if e == "D" else rows[i][0] if e == "K" else e[1]
                    cost += {"D": costs.delete, "K": costs.keep, "R": costs.rerole}[e[0]] + (costs.truncated if e != "D" and rows[i][1] == "truncated" else 0)
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, audit, roles


@pytest.mark.parametrize("costs", [cr.Costs(), cr.Costs(delete=9, insert=1), cr.Costs(rerole=3, delete=3, insert=3, truncated=1)])
def test_every_way(costs):
    rng = random.Random(costs.delete)
    for _ in range(60):
        rows = [(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(0, 4))]
        best = min(x[:2] for x in all_repairs(rows, costs, 2 if len(rows) < 3 else 1))
        cost, audit = cr.cheapest(rows, costs)
        assert (cost, audit) <= best and (audit.count("I") > 1 or (cost, audit) == best), rows
        done = list(cr.applied(rows, audit))
        roles = "".join(role or ("" if letter == "D" else rows[i][0]) for i, letter, role in done)
        assert re.fullmatch("(s?(ua)+)?", roles) and [i for i, _, _ in done if i is not None] == list(range(len(rows)))


def test_longer_ways():
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice("suaua"), rng.choice(["", "", "", "truncated", "blank"])) for _ in range(6)]
        assert cr.cheapest(rows) == min(x[:2] for x in all_repairs(rows, cr.COSTS, 0)), rows


def test_ties_pad_the_end():
    assert cr.cheapest([]) == (0, "")
    assert cr.cheapest([("u", "")]) == (2, "D")
    assert cr.cheapest([("u", ""), ("u", "")]) == (1, "KR")
    assert cr.cheapest([("u", ""), ("a", ""), ("u", "")]) == (2, "KKD")
    with pytest.raises(ValueError):
        cr.cheapest([("u", "")], cr.Costs(insert=0))


def test_a_very_long_conversation():
    rng = random.Random(1)
    rows = [(rng.choice("ua"), rng.choice(["", "", "", "truncated"])) for _ in range(20_000)]
    cost, audit = cr.cheapest(rows)
    assert len(audit) == len(rows) and cost == sum({"K": 0, "R": 1, "D": 2}[x] + (5 if x != "D" and rows[i][1] else 0) for i, x in enumerate(audit))


def report(rows):
    """The contract in plain Python, with every way of repair tried; insertions never pay at the contract's costs."""
    out = {}
    for c in {r[0] for r in rows}:
        after = []
        for i, (_, turn, role, text) in enumerate(r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            role = "user" if fate == 4 else role
            after += [(turn is not None, turn or 0, role, text, i)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        after.sort(key=lambda x: x[:2])
        faults, seen = [], set()
        for _, _, role, text, _ in after:
            body = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [x[1] for x in after if x[0]]
        initials = [x[2][:1] for x in after]
        cost, audit, _ = min(all_repairs(list(zip(initials, faults, strict=True)), cr.COSTS, 0))
        lines, state = [], ""
        for x, e in zip(after, audit, strict=True):
            if e != "D":
                role = x[2] if e == "K" else "assistant" if state == "u" else "user"
                state = role[0]
                lines.append(f"{role}:{x[3]}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[c] = (c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_report(spark):
    rng = random.Random(9)
    texts = ["Done.", "not done", "why?", "", "  \n", None, "ends. \t", "a. ", " ", "x" * 10_000 + "!"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for c in [*range(60), None] for t in [*rng.sample(range(9), rng.randrange(1, 6)), *[None] * (c == 3)]]
    got = [tuple(r) for r in cr.repair_report(table(spark, rows)).collect()]
    want = report(rows)
    assert len(got) == len(want) and {r[0]: r for r in got} == want


def test_everything_dropped(spark):
    c = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in cr.repair_report(table(spark, [(c, 0, "user", "a.")])).collect()] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty(spark):
    assert cr.repair_report(table(spark, [])).count() == 0 == cr.repair(table(spark, [])).count()


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hello."), (1, 3, "user", "Hello."), (2, 0, "user", "only"), (None, 0, "user", "q?"), (None, 1, "assistant", "r.")]
    got = sorted((tuple(r) for r in cr.repair(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (None, 0, "user", "q?"), (None, 1, "assistant", "r.")], key=str)
    inserted = cr.repair(table(spark, [(2, 0, "user", "only.")]), cr.Costs(delete=9, insert=1)).collect()
    assert [tuple(r) for r in sorted(inserted, key=lambda r: r.place)] == [(2, 0, "user", "only."), (2, 1, "assistant", "")]


def test_a_hot_conversation(spark):
    """One conversation holds most rows: it streams through its task."""
    rows = [(0, t, "ua"[t % 2] + "x", f"{t}.") for t in range(6000)] + [(c, 0, "user", "q.") for c in range(1, 40)]
    got = {r.conv_id: r for r in cr.repair_report(table(spark, rows)).collect()}
    assert len(got) == 40 and len(got[0].audit) > 5000 and got[0].truncated > 0


def test_against_sql(spark):
    con, at = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"create view conversations as select * from '{at}/conversations.parquet'")
    out = queries.op12_conversation_repair(spark, at)
    want = con.execute(queries.ORACLE_SQL["op12_conversation_repair"]).fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))

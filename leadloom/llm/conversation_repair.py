"""Cheapest repair of conversations: an integer shortest path whose weights carry cost in high digits and the audit in low ones.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in pairs. Each step through a
conversation keeps, reroles or deletes its next row, or inserts a row; the letters of the steps are the audit. A step's weight is
its cost above WIDTH digits, and its letter's digit at the place of the step in the audit, counted from the front. Digits are
in the order of the letters, and 0, below all of them, stands for the end; so the least sum of weights is the least cost and,
among equal costs, the first audit in ASCII order, and the audit can be read off the sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.common import hashed_groups, saved

BLANK = r"\A[\x20\x09-\x0D]*\z"
TRUNCATED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
MARKS = r"[.!?]"
#: Letters of edits in ASCII order; a letter's digit is its place, from 1. 0 pads the end of an audit.
LETTERS = "DIKR"
BITS = 3
#: The states of `(s?(ua)+)?`: nothing yet, after s, after u, after a; where each initial leads; and where a sequence may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """What edits cost; insert must cost something, or conversations could grow for ever."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


COSTS = Costs()


def moves(row: tuple[str, str] | None, state: int, costs: Costs) -> Iterator[tuple[int, str, int]]:
    """cost, letter and new state of each edit of a row (initial, fault), or without one of each insertion."""
    if row is None:
        for role in "ua":
            if (state, role) in NEXT:
                yield costs.insert, "I", NEXT[state, role]
        return
    initial, fault = row
    yield costs.delete, "D", state
    if fault not in ("blank", "duplicate"):
        more = costs.truncated if fault == "truncated" else 0
        if (state, initial) in NEXT:
            yield costs.keep + more, "K", NEXT[state, initial]
        for role in "ua":
            if (state, role) in NEXT:
                yield costs.rerole + more, "R", NEXT[state, role]


def _to_go(rows: list[tuple[str, str]], costs: Costs) -> list[list[int]]:
    """The least cost from each row and state to the end."""
    never = 1 << 62

    def inserting(now: list[int]) -> list[int]:
        for _ in range(4):  # no cheapest way has more insertions in a row
            now = [min([now[s], *(c + now[t] for c, _, t in moves(None, s, costs))]) for s in range(4)]
        return now

    levels = [inserting([0 if s in FINAL else never for s in range(4)])]
    for row in reversed(rows):
        levels.append(inserting([min(c + levels[-1][t] for c, _, t in moves(row, s, costs)) for s in range(4)]))
    return levels[::-1]


def cheapest(rows: list[tuple[str, str]], costs: Costs = COSTS) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows (initial of the role, fault), ties by the audit in ASCII order.

    The graph's nodes are (row, rows inserted so far, state); steps that no cheapest way takes are left out first, by plain
    costs. Where the ways that are left meet in one node, the digits so far are final: they are read off and sums start again
    at 0, so that integers stay short on long conversations.
    """
    if costs.insert <= 0:
        raise ValueError("an insertion must cost something")
    to_go = _to_go(rows, costs)
    audit: list[str] = []
    layer, place = {(0, 0): 0}, 0  # (inserted, state): least sum; rows since sums began
    wide = lambda i, state: len(rows) - i + to_go[i][state] // costs.insert
    width = wide(0, 0)

    def read(total: int, n: int) -> str:
        return "".join(LETTERS[(total >> BITS * (width - 1 - k)) % (1 << BITS) - 1] for k in range(n))

    def step(out: dict[tuple[int, int], int], key: tuple[int, int], total: int, cost: int, letter: str, at: int) -> None:
        total += (cost << BITS * width) + ((LETTERS.index(letter) + 1) << BITS * (width - 1 - at))
        out[key] = min(total, out.get(key, total))

    for i in range(len(rows) + 1):
        open_nodes = sorted(layer)
        while open_nodes:  # by rows inserted, so that a node's sum is final when its own insertions are looked at
            inserted, state = heappop(open_nodes)
            for cost, letter, to in moves(None, state, costs):
                if to_go[i][state] == cost + to_go[i][to]:
                    if (key := (inserted + 1, to)) not in layer:
                        heappush(open_nodes, key)
                    step(layer, key, layer[inserted, state], cost, letter, place + inserted)
        if i == len(rows):
            break
        after: dict[tuple[int, int], int] = {}
        for (inserted, state), total in layer.items():
            for cost, letter, to in moves(rows[i], state, costs):
                if to_go[i][state] == cost + to_go[i + 1][to]:
                    step(after, (inserted, to), total, cost, letter, place + inserted)
        layer, place = after, place + 1
        if len(layer) == 1:
            [((inserted, state), total)] = layer.items()
            audit.append(read(total, place + inserted))
            layer, place, width = {(0, state): 0}, 0, wide(i + 1, state)
    total, inserted = min((total, inserted) for (inserted, state), total in layer.items() if state in FINAL)
    audit.append(read(total, place + inserted))
    return to_go[0][0], "".join(audit)


def applied(rows: list[tuple[str, str]], audit: str) -> Iterator[tuple[int | None, str, str]]:
    """For each letter the index of its row (None: inserted), the letter, and the new role's initial ('' if the row keeps its own or goes).

    The sequence has one form for given letters: only a kept first row can be the system's.
    """
    at, state = 0, 0
    for letter in audit:
        role = ""
        if letter == "K":
            state = NEXT[state, rows[at][0]]
        elif letter != "D":
            role = "a" if state == 2 else "u"
            state = NEXT[state, role]
        yield (None if letter == "I" else at), letter, role
        at += letter != "I"


EDITS = pa.schema([("conv_id", pa.int64()), ("row", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("new_role", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())])


def _edits(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "initial", "fault")), strict=True))
        for some in _in_blocks(edit for conv, group in groupby(rows, lambda r: r[0]) for edit in decided(conv, [r[1:] for r in group])):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), EDITS.types, strict=True)], schema=EDITS)

    def decided(conv: int | None, turns: list[tuple[str, str]]) -> Iterator[tuple]:
        cost, audit = cheapest(turns, costs)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairwise(turns))
        for place, (row, letter, role) in enumerate(applied(turns, audit)):
            yield conv, row, place, letter, ROLES.get(role), *((cost, illegal, audit) if place == 0 else (None, None, None))

    return run


def _in_blocks(rows: Iterator[tuple], size: int = 1 << 14) -> Iterator[list[tuple]]:
    while some := list(islice(rows, size)):
        yield some


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, copy) with row (from 0 in each conversation by turn, null first, ties by content), initial and fault.

    The first fault counts: blank (nothing but blanks), duplicate (role and text seen earlier), truncated (the last character
    that isn't blank is no mark), else ''.
    """
    digest = F.md5(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "copy")
    same = Window.partitionBy("conv_id", "digest").orderBy("row")
    fault = (
        F.when(F.col("text").rlike(BLANK), "blank").when(F.row_number().over(same) > 1, "duplicate").when(F.col("text").rlike(TRUNCATED), "truncated").otherwise("")
    )
    return turns.withColumn("digest", digest).withColumn("row", (F.row_number().over(order) - 1).cast("long")).withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1)).drop("digest", "copy")


def edits(rows: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """conv_id, row (null: inserted), place in the audit, edit, new_role, for the rows of faults(); one conversation is decided in one task.

    Only initials and faults travel to the decision; a conversation's (some 100 bytes a row) fit in a task. The first edit of a
    conversation carries its cost, its number of illegal neighbours and its audit, the others null.
    """
    slim = rows.select("conv_id", "row", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "row")
    return slim.select("conv_id", "initial", "fault").mapInArrow(_edits(costs), "conv_id long, row long, place long, edit string, new_role string, cost long, illegal long, audit string")


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, role, text; kept rows as they are, reroled ones with their new role, inserted ones without text."""
    return (
        decided.filter("edit <> 'D'")
        .alias("e")
        .join(rows.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("e.row") == F.col("r.row")), "left")
        .select("e.conv_id", "e.place", F.coalesce("e.new_role", "r.role").alias("role"), F.coalesce("r.text", F.lit("")).alias("text"))
    )


def repair(conversations: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """conversations (conv_id, turn, role, text) repaired: conv_id, place (from 0), role, text.

    Null roles and texts are one space; a null conv_id is a conversation of its own. An empty table stays empty.
    """
    rows = saved(faults(spaced(conversations).withColumn("copy", F.lit(0))), "turns")
    kept = repaired(rows, edits(rows, costs))
    return kept.withColumn("place", (F.row_number().over(Window.partitionBy("conv_id").orderBy("place")) - 1).cast("long"))


def spaced(conversations: DataFrame) -> DataFrame:
    space: Column = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of `conv_id:turn` modulo 20 (null: one space); copy tells a repeated row from the first."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "utf-8")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", MARKS, "")).otherwise(F.col("text"))
    return (
        spaced(conversations)
        .withColumn("fate", fate)
        .filter("fate <> 0")
        .withColumns({"text": text, "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))})
        .withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("fate")
    )


def repair_report(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conversation: what was wrong with its damaged rows, and their cheapest repair.

    Nulls are one space (a null turn comes first and counts for no gap); an empty role has no initial and isn't kept; a null conv_id is a conversation of its own. Rows with one
    turn are ordered by content; repeated rows are duplicates. Long texts travel whole but aren't read by the decision. An
    empty table gives an empty result; other columns play no part.
    """
    rows = saved(faults(damaged(conversations)), "turns")
    decided = saved(edits(rows), "edits")
    count = lambda f: F.count_if(F.col("fault") == f)
    found = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), *[count(f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    decisions = decided.filter("place = 0").select("conv_id", "cost", "illegal", "audit")
    lined = repaired(rows, decided).select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("piece"))
    hashes = hashed_groups(lined, "conv_id", ["place"], "piece", "\n").withColumnRenamed("sha256", "repaired_sha256")
    all_ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    out = all_ids
    for part in (found, decisions, hashes):
        out = out.join(part.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )

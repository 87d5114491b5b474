"""Documents whose sets of word n-grams have a high Jaccard similarity, by a token-group matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SpanHash, flat, mix64, saved, steps, text_of, tidy
from leadloom.llm.components import components
from leadloom.llm.exact_dedup import NULL_ID, _filtered

#: Counters of the sketch by whose counts tokens are ordered; their number doesn't grow with the input.
COUNTERS, SLICES = 1 << 19, 64
#: Tokens of their prefixes that two similar documents share at least; prefixes have as many more.
SHARED = 3
#: Members of a group that are compared with as many queries at a time, and their tokens, about.
BLOCK_MEMBERS, BLOCK_TOKENS = 256, 1 << 20
#: Words of 64 bits of a set's parities: a bit for each of 64 * WORDS classes of tokens, whether it has an odd number of them.
WORDS = 4
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1 for k in range(1, 65)]


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its word n-grams; a row of fewer words has one for all of them."""
    data, bounds = flat(text)
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = ~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1]) if len(data) else np.zeros(0, bool)
    end = ~blank & (np.concatenate([blank[1:], [True]]) | edge[1:]) if len(data) else np.zeros(0, bool)
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    word = SpanHash(_LOWER[data]).of(starts, ends)
    first = np.searchsorted(starts, bounds)
    grams = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        grams += word[k : len(word) - width + 1 + k] * np.uint64(_MULTIPLIERS[k])
    grams = mix64(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            whole = (word[a:b] * np.array(_MULTIPLIERS[: b - a], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(whole + np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """WORDS numbers for each set. Two sets differ in at least as many tokens as their parities differ in bits."""
    tokens, ends = np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)])
    place = (tokens >> np.uint64(48)).astype(np.int64) % (64 * WORDS)
    bit, out = np.uint64(1) << (place % 64).astype(np.uint64), np.zeros((len(sets), WORDS), np.uint64)
    for k in range(WORDS):
        so_far = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(place // 64 == k, bit, np.uint64(0)))])
        out[:, k] = so_far[ends[1:]] ^ so_far[ends[:-1]]
    return out.view(np.int64)


def _masks(rows: DataFrame, key: str, odd: str, even: str) -> DataFrame:
    """For each key, `most` (its largest set) and by word the bits that any (`odd`) and that all (`even`) of its parities have."""
    words = range(WORDS)
    return rows.groupBy(key).agg(F.max("most").alias("most"), *[F.bit_or(f"{odd}{k}").alias(f"any{k}") for k in words], *[F.bit_and(f"{even}{k}").alias(f"all{k}") for k in words])


def _may_link(percent: int) -> str:
    """Whether parities leave it open that a document (own_most, own_any, own_all) links with a member of a group (most, any, all).

    Sets of x and y tokens that link differ in (x + y) * (100 - percent) / (100 + percent) at most, and y is at most 100 * x / percent.
    """
    apart = " + ".join(f"bit_count(own_all{k} & ~any{k}) + bit_count(all{k} & ~own_any{k})" for k in range(WORDS))
    return f"({apart}) * {percent * (100 + percent)} <= ({percent} * own_most + least({percent} * most, 100 * own_most)) * {100 - percent}"


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), text_of(text).alias("text"))


def sketch(texts: DataFrame, width: int) -> np.ndarray:
    """How many documents have a token, added up by token hash modulo COUNTERS over all documents: an array of fixed size."""
    part = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for step in steps(batch):
                for own in shingle_sets(step.column("text"), width):
                    if len(own):
                        np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[k * part : (k + 1) * part].tobytes() for k in range(SLICES)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                more = np.frombuffer(c, np.uint32)
                sums[k] = sums.get(k, 0) + more.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    rows = texts.select("text").mapInArrow(tidy(count), kind).repartition(8, "slice").mapInArrow(tidy(add), kind).collect()
    out = np.zeros(COUNTERS, np.uint64)
    for r in rows:
        out[r["slice"] * part : (r["slice"] + 1) * part] = np.frombuffer(bytes(r["counts"]), np.uint64)
    return out


def prefixes(texts: DataFrame, counts, width: int, percent: int) -> DataFrame:
    """doc, n, signature of the set (null for an empty one), its parities, and the rarest tokens: all sets of the wanted similarity share SHARED of them.

    Of sets x, y that link, both with at most o = ceil(percent * n / 100) tokens to share, the first n - o + SHARED
    tokens of each, in one order of all tokens, share SHARED. The order is by sketch count, then by hash. A set too
    small to link with any other has no prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = counts.value
        for batch in batches:
            for step in steps(batch):
                sets = shingle_sets(step.column("text"), width)
                heads = []
                for own in sets:
                    n = len(own)
                    if 100 * n < percent * (n + 1):
                        heads.append(own[:0].view(np.int64))
                        continue
                    order = np.argsort(rank[(own % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")
                    heads.append(own[order[: n - -(-percent * n // 100) + SHARED]].view(np.int64))
                ends, odd = np.cumsum([0, *(len(h) for h in heads)]), parities(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        step.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(heads))), *[pa.array(odd[:, k].copy()) for k in range(WORDS)],
                    ],
                    ["doc", "n", "signature", "prefix", *[f"odd{k}" for k in range(WORDS)]],
                )

    return texts.mapInArrow(tidy(run), "doc long, n long, signature binary, prefix array<long>" + "".join(f", odd{k} long" for k in range(WORDS)))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                yield pa.RecordBatch.from_arrays([step.column("doc"), pa.array([s.tobytes() for s in shingle_sets(step.column("text"), width)], pa.binary())], ["doc", "tokens"])

    return docs.select("doc", "text").mapInArrow(tidy(run), "doc long, tokens binary")


class _Joined(dict):
    """Which documents a block has found to be connected."""

    def root(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        self[self.root(a)] = self.root(b)


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """Links between the members (role 0) and the queries (role 1) of each block and part of each group; rows: grp, block, part, role, doc, linked, tokens.

    Rows come sorted, members first, and a block's members are all that a task holds. Members that are linked to the
    group's leader are connected to begin with. A query is compared with a member unless they are connected already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, joined = None, [], [], _Joined()
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("grp", "block", "part", "role", "doc", "linked")]
            tokens = batch.column("tokens")
            for k, (grp, block, part, role, doc, linked) in enumerate(zip(*columns, strict=True)):
                if (grp, block, part) != at:
                    at, ids, sets, joined = (grp, block, part), [], [], _Joined()
                own = np.frombuffer(tokens[k].as_buffer(), np.uint64)
                if role == 0:
                    ids.append(doc)
                    sets.append(own.copy())
                    if linked:
                        joined.join(doc, grp)
                    continue
                for other, theirs in zip(ids, sets, strict=True):
                    small, large = sorted((len(own), len(theirs)))
                    if doc == other or 100 * small < percent * large or joined.root(doc) == joined.root(other):
                        continue
                    here = np.searchsorted(theirs, own)
                    both = int((theirs[np.minimum(here, len(theirs) - 1)] == own).sum())
                    if 100 * both >= percent * (small + large - both):
                        found.append((doc, other))
                        joined.join(doc, other)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return rows.repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "role", "doc").mapInArrow(tidy(run), "a long, b long")


def _blocks():
    """How many blocks a group of `members` members with `tokens` tokens in all has."""
    return F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("blocks")


def _dealt(rows: DataFrame, groups: DataFrame, mine: str, others: str) -> DataFrame:
    """Rows, each in one of its group's `mine` by a hash and in all of its `others`. groups: a table of grp, blocks, parts."""
    dealt = rows.join(groups.select("grp", "blocks", "parts"), "grp").withColumn(mine, F.pmod(F.xxhash64("doc"), F.col(f"{mine}s")).cast("int"))
    return dealt.withColumn(others, F.explode(F.sequence(F.lit(0), F.col(f"{others}s") - 1))).drop("blocks", "parts")


def similar_links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: doc, n, signature of every row; links (a, b) connect all representatives of equal sets
    that a chain of similar pairs connects, by pairs that were verified.

    1. Equal sets are one class, represented by its smallest id. A sketch of fixed size counts tokens over all texts.
    2. Representatives are partitioned into groups of similar ones: each prefix token names as leader the smallest id
       that has it, and a document joins the leader with which it shares most (SHARED at least), else it leads itself.
       Members that are verified to be similar to their leader are linked; those are one component.
    3. The token-group matrix holds the union of the prefix tokens of each group, once for each token and group however
       many members have it. A member's overlap with another group's union bounds its overlap with the members, so it
       opens only groups with which it shares SHARED tokens or more, of fitting size; of two groups the smaller one
       asks. Parities of whole sets are compared in that join: most groups that have one rare token of a document by
       chance differ from it in more tokens than a link allows, so such pairs, whose number grows with the square of
       the input, make few rows (of long sets, of over some 2,000 tokens, parities say little). The rarest token that two
       prefixes share has SHARED - 1 shared ones after it in both, so it isn't among the
       last of either: groups are met by the other tokens alone, and tokens of a template, which come last in the
       order, don't bring every document to every group. A token counts only where enough of both sets comes after it.
       A member that isn't linked to its leader opens its own group too. An opened group's members are compared in
       blocks with its queries in parts, leaving out pairs that are connected already, so members linked to the leader
       are never compared.
    """
    spark = docs.sparkSession
    texts = _texts(docs, key, text)
    counts = spark.sparkContext.broadcast(sketch(texts, width))
    classes = saved(prefixes(texts, counts, width, percent), "sets")
    heads = classes.filter("signature is not null").groupBy("signature").agg(F.min(F.struct("doc", "n", "prefix")).alias("r")).select("r.*")
    postings = heads.filter("size(prefix) > 0").select("doc", "n", F.size("prefix").alias("many"), F.posexplode("prefix").alias("pos", "token"))
    postings = saved(postings.select("doc", "n", "token", "pos", F.expr(f"pos <= many - {SHARED}").alias("core")), "postings")
    leads = postings.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("lead"), F.count("*").alias("times"))
    leads = saved(leads.filter("times > 1").drop("times"), "leads")
    shared = saved(postings.join(leads, "token"), "shared")
    fits = f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)"
    led = shared.filter(f"doc <> lead.doc and {fits}").groupBy("doc", F.col("lead.doc").alias("grp")).count().filter(f"count >= {SHARED}")
    home = saved(led.groupBy("doc").agg(F.min(F.struct((-F.col("count")).alias("fewer"), "grp")).alias("best")).select("doc", "best.grp"), "home")
    member = saved(shared.select("doc", "n").distinct().join(home, "doc", "left").withColumn("grp", F.coalesce("grp", "doc")), "members")
    sizes = member.groupBy("grp").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("tokens"))
    sizes = saved(sizes.select("*", _blocks()), "sizes")
    grouped = saved(shared.select("token", "doc", "n", "pos", "core").join(member.join(sizes.select("grp", "members", "low", "high"), "grp"), ["doc", "n"]), "grouped")
    union = ["members", "low", "high"]
    matrix = grouped.groupBy("token", "grp").agg(*[F.max(c).alias(c) for c in union], F.max("core").alias("core"), F.max(F.expr(f"100 * n - {100 + percent} * pos")).alias("slack"))
    matrix = saved(matrix, "matrix")
    # a doc_id that repeats has all its texts' parities
    bits = saved(_masks(classes.filter("signature is not null").withColumn("most", F.col("n")), "doc", "odd", "odd"), "bits")
    group_bits = saved(_masks(member.select("doc", "grp").join(bits, "doc"), "grp", "any", "all"), "group_bits")
    own_bits = bits.select("doc", *[F.col(c).alias(f"own_{c}") for c in bits.columns if c != "doc"])
    own = grouped.filter("core").select("token", "doc", "n", "pos", F.col("grp").alias("of"), F.col("members").alias("beside")).join(own_bits, "doc")
    asks = "grp <> of and (members > beside or members = beside and grp < of)"
    fits = f"100 * n >= {percent} * low and 100 * high >= {percent} * n"
    # if this is the rarest token that two sets share, they share no more than what stands from it on in each
    ahead = f"slack >= {percent} * n and 100 * n - {100 + percent} * pos >= {percent} * low"
    others = matrix.filter("core").drop("core").join(group_bits, "grp")
    met = saved(own.join(others, "token").filter(f"{asks} and {fits} and {ahead} and {_may_link(percent)}").select("doc", "grp").distinct(), "met")
    across = met.join(grouped.select("doc", "token"), "doc").join(matrix.select("token", "grp"), ["token", "grp"]).groupBy("doc", "grp").agg(F.count("*").alias("c"))
    across = saved(across.filter(f"c >= {SHARED}").select("doc", "grp"), "across")
    asked = saved(across.select("grp").distinct(), "asked")

    # the sets of the documents that any group needs: leaders and those they lead, queries, and members of groups they open
    opens = member.join(asked, "grp", "left_semi")
    wanted = saved(home.select("doc").union(home.select("grp")).union(across.select("doc")).union(opens.select("doc")).distinct(), "wanted")
    tokens = saved(_sets(_filtered(texts, wanted, "doc").join(wanted, "doc", "left_semi"), width), "tokens")

    led = saved(home.select("grp").distinct().join(sizes, "grp").select("grp", "blocks"), "led")
    leaders = led.select("grp", F.lit(0).alias("role"), F.col("grp").alias("doc"), F.lit(False).alias("linked"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("block"))
    followers = _dealt(home.select("grp", F.lit(1).alias("role"), "doc", F.lit(False).alias("linked")), led.select("grp", F.lit(1).alias("blocks"), F.col("blocks").alias("parts")), "part", "block")
    near = saved(_open(leaders.unionByName(followers).join(tokens, "doc"), percent).distinct(), "near")

    member = member.join(near.select(F.col("a").alias("doc"), F.lit(True).alias("linked")).distinct(), "doc", "left").withColumn("linked", F.coalesce("linked", F.col("doc") == F.col("grp")))
    member = saved(member, "linked")
    inside = member.filter("not linked").select("doc", "grp")
    asked = across.unionByName(inside)
    opened = asked.groupBy("grp").agg(F.count("*").alias("queries")).join(sizes, "grp").withColumn("parts", F.ceil(F.col("queries") / BLOCK_MEMBERS).cast("int"))
    opened = saved(opened, "opened")
    queries = _dealt(asked.select("grp", F.lit(1).alias("role"), "doc", F.lit(False).alias("linked")), opened, "part", "block")
    members = _dealt(member.select("grp", F.lit(0).alias("role"), "doc", "linked"), opened, "block", "part")
    return classes.select("doc", "n", "signature"), near.unionByName(_open(members.unionByName(queries).join(tokens, "doc"), percent))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that a chain of links reaches) for every row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of word n-grams, A-Z lower-cased. Fewer
    words than the width are one n-gram as a whole. A row without words or text links with nothing. Rows that repeat a
    doc_id are one document in the links; a null doc_id is the smallest id there is. An empty table gives an empty one;
    other columns aren't read.
    """
    classes, links = similar_links(docs, key, text, width, percent)
    reach = components(links)
    worded = classes.filter("signature is not null")
    ids = worded.groupBy("signature").agg(F.min("doc").alias("node"))
    ids = saved(ids.join(reach, "node", "left").select("signature", F.coalesce("component", "node").alias("component")), "classes")
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    out = worded.join(ids, "signature").select("doc", "n", "component")
    out = out.unionByName(classes.filter("signature is null").select("doc", "n", F.col("doc").alias("component")))
    return out.select(null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each component: that whose id names it. Rows with a null id, or without words, stay.

    Of rows that repeat an id, one stays at most: the one whose columns have the least hash (of equal rows, any). Only rows of
    repeated ids are shuffled for that.
    """
    found = jaccard_components(docs, key, **options).filter("doc_id is not null").select(F.col("doc_id").alias(key), "component_id", "n_shingles")
    gone = found.filter("n_shingles > 0").select(key, "component_id").distinct().filter(~F.col(key).eqNullSafe(F.col("component_id")))
    kept = docs.join(gone.select(key), key, "left_anti")
    again = saved(docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_times")).filter("_times > 1").select(key), "repeated")
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, key, "left_semi").select(F.col(key).alias("_id"), whole.alias("_row"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]).alias("_hash"))
    one = one.groupBy("_id").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    return kept.join(again, key, "left_anti").unionByName(one)

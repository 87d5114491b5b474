"""A z-fast trie of conversations: one compacted node for each prefix at which conversations part or end.

A compacted node stands for the depths (above, extent] of one path. It is filed under the digest of its path's prefix at the
handle: the depth in (above, extent] that the largest power of two divides. A fat binary search over handles finds, in as many
lookups as the length has bits, the deepest node whose whole extent a conversation has; below it lies the exit node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.common import hashed_groups, saved

#: Turns that are located before any of them is inserted, and turns that one trie holds before its nodes are handed on.
BATCH_TURNS, TRIE_TURNS = 1 << 14, 1 << 19
#: Bits of an id in one piece of the list of conversations that end at one node.
ID_BITS = 12
ROOT = b"\0" * 16

PATHS = "conv_id long, depth long, prefix binary, parent binary, bytes long, n_convs long, path boolean, last boolean"
ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("prefix", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("n_convs", pa.int64()), ("path", pa.bool_()), ("last", pa.bool_())])


def handle(above: int, extent: int) -> int:
    """The two-fattest number in (above, extent]: that which the largest power of two divides."""
    return extent & (-1 << ((above ^ extent).bit_length() - 1))


class ZFastTrie:
    """Conversations as sequences of prefix digests, d[0] the root's; equal digests stand for equal prefixes.

    A node is a list: depth above, extent, digests of a conversation that passes, its least conversation, conversations that
    end at its extent.
    """

    def __init__(self):
        self.root = [0, 0, [ROOT], None, 0]
        self.by_handle: dict[bytes, list] = {}
        self.below: dict[bytes, list] = {}  # by the digest of the first depth of the node's edge

    def exit(self, digests: list[bytes], start: list | None = None) -> list:
        """The deepest node whose extent is a prefix of digests; start: a node already known to be one."""
        node = start or self.root
        low, high = node[1], len(digests) - 1
        while low < high:
            middle = handle(low, high)
            found = self.by_handle.get(digests[middle])
            if found is not None and found[1] < len(digests) and found[2][found[1]] == digests[found[1]]:
                node, low = found, found[1]
            else:
                high = middle - 1
        return node

    def _file(self, node: list) -> None:
        self.by_handle[node[2][handle(node[0], node[1])]] = node
        self.below[node[2][node[0] + 1]] = node

    def _add(self, conv: int, digests: list[bytes], node: list) -> None:
        node = self.exit(digests, node)
        length = len(digests) - 1
        child = self.below.get(digests[node[1] + 1]) if node[1] < length else None
        if child is not None:  # the conversation leaves the child's edge, or ends on it: the edge is cut there
            low, high = node[1] + 1, min(length, child[1] - 1)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if child[2][middle] == digests[middle] else (low, middle - 1)
            del self.by_handle[child[2][handle(child[0], child[1])]]
            upper = [child[0], low, child[2], None, 0]
            child[0] = low
            self._file(child)
            self._file(upper)
            node = upper
        if node[1] < length:
            node = [node[1], length, digests, None, 0]
            self._file(node)
        node[3] = conv if node[3] is None else min(node[3], conv)
        node[4] += 1

    def insert(self, batch: list[tuple[int, list[bytes]]]) -> None:
        """All of a batch are located in the trie as it is; each is then inserted below the node found, which stays on its path."""
        located = [(conv, digests, self.exit(digests)) for conv, digests in batch]
        for conv, digests, node in located:
            self._add(conv, digests, node)

    def edges(self) -> Iterator[tuple[int, int, list[bytes], int, int]]:
        """Depth above, extent, digests, least member and number of members of every compacted node, deepest first."""
        nodes = sorted(self.below.values(), key=lambda n: -n[1])
        ends = {n[2][n[1]]: n for n in [self.root, *nodes]}
        least, members = {k: n[3] for k, n in ends.items()}, {k: n[4] for k, n in ends.items()}
        for above, extent, digests, _, _ in nodes:
            own, up = digests[extent], digests[above]
            yield above, extent, digests, least[own], members[own]
            least[up] = least[own] if least[up] is None else min(least[up], least[own])
            members[up] += members[own]
        if members[ROOT]:
            yield -1, 0, [ROOT], least[ROOT], members[ROOT]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | None, int]]:
    for b in batches:
        yield from zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist(), b.column("bytes").to_pylist(), strict=True)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in; out come every conversation's path, and the nodes of one trie after the other with each edge expanded."""
    sizes: dict[bytes, int] = {}
    trie, batch, waiting, held, out = ZFastTrie(), [], 0, 0, []

    def nodes() -> Iterator[tuple]:
        for above, extent, digests, least, n in trie.edges():
            for d in range(above + 1, extent + 1):
                yield least, d, digests[d], digests[d - 1] if d else None, sizes.get(digests[d], 0), n, False, False

    def tables(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, BATCH_TURNS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), ARROW.types, strict=True)], schema=ARROW)

    for conv, turns in groupby(_rows(batches), lambda r: r[0]):
        digests = [ROOT]
        for _, digest, size in turns:
            if digest is not None:
                digests.append(hashlib.blake2b(digests[-1] + digest, digest_size=16).digest())
                sizes[digests[-1]] = size
        end = len(digests) - 1
        out += [(conv, d, x, None, None, None, True, d == end) for d, x in enumerate(digests)]
        batch.append((conv, digests))
        waiting += len(digests)
        if waiting >= BATCH_TURNS:
            trie.insert(batch)
            yield from tables(iter(out))
            held, batch, waiting, out = held + waiting, [], 0, []
        if held >= TRIE_TURNS:
            yield from tables(nodes())
            trie, sizes, held = ZFastTrie(), {}, 0
    trie.insert(batch)
    yield from tables(chain(out, nodes()))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1 by turn, null first, then by content), digest of role and text, bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256)
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return slim.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "bytes")


def prefix_nodes(paths: DataFrame, near: str = "conv_id") -> DataFrame:
    """Every distinct prefix of the sequences in paths (conv_id, part, pos, digest, bytes), the empty one included, with its sums.

    Sequences are ordered by part and pos; a row with a null digest makes a sequence exist without adding to it. Rows with one
    value of `near` are dealt to one task; a task files its sequences in z-fast tries of bounded size, batch after batch, and
    hands on each edge depth by depth with its number of members, so that a prefix that very many share is one row of a trie.
    Spark adds these up by prefix. An empty table gives no rows. A sequence's digests (some 60 bytes a turn) fit in a task.

    Sums over subtrees don't climb the trie level by level: the nodes with one least member are a chain that goes down to that
    member's end, and a chain's sum counts for every prefix of the member's path above the chain, at most one row a turn.
    """
    grown = saved(paths.repartition(near).sortWithinPartitions(near, "conv_id", "part", "pos").select("conv_id", "digest", "bytes").mapInArrow(_grow, PATHS), "paths")
    members = grown.filter("path").select("conv_id", "depth", "prefix", "last")
    nodes = saved(grown.filter("not path").groupBy("prefix", "parent", "depth", "bytes").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")), "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    down = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaf = F.col("n_children").isNull().cast("long")
    chains = saved(
        nodes.join(kids, "prefix", "left").withColumns(
            {
                "saved_own": F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(down),
                "leaves_own": F.sum(leaf).over(down),
                "top": F.lead("depth").over(Window.partitionBy("conv_id").orderBy(F.desc("depth"))).isNull(),
            }
        ),
        "chains",
    )
    tops = chains.filter("top and depth > 0")
    hung = members.join(tops.select("conv_id", F.col("depth").alias("from"), "saved_own", "leaves_own"), "conv_id").filter("depth < `from`")
    hung = hung.groupBy("prefix").agg(F.sum("saved_own").alias("saved_below"), F.sum("leaves_own").alias("leaves_below"))
    parents = tops.select("parent", F.col("prefix").alias("at")).join(nodes.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_least")), "parent")
    block = F.shiftright("conv_id", ID_BITS)
    ids = members.filter("last").groupBy("prefix", block.alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ends = hashed_groups(ids.select("prefix", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("piece")), "prefix", ["block"], "piece", ",")
    added = lambda own, below: (F.col(own) + F.coalesce(below, F.lit(0))).cast("long")
    return (
        chains.join(hung, "prefix", "left")
        .join(parents.select(F.col("at").alias("prefix"), "parent_least"), "prefix", "left")
        .join(ends, "prefix", "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.when(F.col("top"), F.col("parent_least")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            added("leaves_own", "leaves_below").alias("n_leaves"),
            added("saved_own", "saved_below").alias("saved_tokens"),
            F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
            F.lower(F.hex("prefix")).alias("prefix"),
        )
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations as they are.

    Null roles and texts are empty; turns are ordered by turn, null first, ties by content; rows with a null conv_id belong to
    no conversation and are left out. Repeated rows are turns of their own. Other columns play no part.
    """
    rows = turns(conversations)
    return prefix_nodes(rows.select("conv_id", F.lit(1).alias("part"), "pos", "digest", "bytes"))


def crc(column: Column) -> Column:
    return F.crc32(F.encode(column.cast("string"), "utf-8"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % 5, then c's own after its first h, h = crc32(c) % 9."""
    rows = saved(turns(conversations), "turns")
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    convs = rows.filter("pos = 1").select("conv_id", base, (crc(F.col("conv_id")) % 9).cast("int").alias("h"))
    heads = rows.filter((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    given = convs.filter("conv_id <> base").join(heads, "base").select("base", "conv_id", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("t"))
    kept = rows.select("*", base).filter((F.col("conv_id") == F.col("base")) | (F.col("pos") > crc(F.col("conv_id")) % 9))
    none = F.lit(0).cast("long")
    return (
        convs.select("base", "conv_id", F.lit(0).alias("part"), none.alias("pos"), F.lit(None).cast("binary").alias("digest"), none.alias("bytes"))
        .unionByName(given.select("base", "conv_id", F.lit(1).alias("part"), "t.pos", "t.digest", "t.bytes"))
        .unionByName(kept.select("base", "conv_id", F.lit(2).alias("part"), "pos", "digest", "bytes"))
    )


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The contract's nodes: prefix_nodes of the rebuilt conversations. Nulls, ties and repeated rows as in prefix_trie."""
    return prefix_nodes(rebuilt(conversations), near="base")

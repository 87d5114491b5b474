"""Exact duplicates by a log-structured merge index of digests."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import saved, steps, text_of

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Normalised bytes that a memtable holds before it is flushed.
MEMTABLE_BYTES = 48 << 20
#: Rows that a bucket of the index should have, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 1 << 20
#: Bits of a run's filter for each digest that its bucket should have, and probes of a digest.
FILTER_BITS, PROBES = 12, 4
#: Runs that one compaction merges at most; more are merged in two levels, a root of their number at a time.
FAN_IN = 256
_RUN = pa.schema(
    [("run", pa.int64()), ("bucket", pa.int32()), ("slots", pa.int32()), ("filter", pa.binary()), ("digests", pa.binary()), ("keep_len", pa.list_(pa.int64())), ("keep_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("digest", pa.binary()), ("ids", pa.list_(pa.int64()))]
)
_RUN_SQL = "run long, bucket int, slots int, filter binary, digests binary, keep_len array<long>, keep_id array<long>, n array<long>, times array<int>, digest binary, ids array<long>"
_BLOCK_SQL = "run long, bucket int, slots int, filter binary, digests binary, keep_len array<long>, keep_id array<long>, n array<long>, times array<int>"
_ENTRY = "digest binary, grp long, keep_id long, group_size long, runs int"


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, BLANKS)


def _probes(digests: np.ndarray, slots: int) -> np.ndarray:
    """PROBES slots for each 32-byte digest."""
    parts = digests.view("<u4").reshape(len(digests), 8)[:, :PROBES]
    return parts % np.uint32(slots)


def _blocks(run: int, digests: np.ndarray, length: np.ndarray, keep: np.ndarray, n: np.ndarray, times: np.ndarray, buckets: int, slots: int) -> Iterator[dict]:
    """Sorted digests and what they keep as a run: a block with a filter for each bucket. A filter that is larger than its digests is left for the reader to make from them."""
    bucket = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) * buckets >> 32
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.ascontiguousarray(digests[a:b])
        yield {
            "run": run, "bucket": int(bucket[a]), "slots": slots, "filter": np.packbits(_filter(own, slots)).tobytes() if slots // 8 <= own.size else None,
            "digests": own.tobytes(), "keep_len": length[a:b], "keep_id": keep[a:b], "n": n[a:b], "times": times[a:b],
        }


def _filter(digests: np.ndarray, slots: int) -> np.ndarray:
    bits = np.zeros(slots, bool)
    bits[_probes(digests, slots).ravel()] = True
    return bits


def flush(run: int, rows: dict, buckets: int, slots: int) -> list[dict]:
    """A memtable as a run: its blocks, and the members of each digest, which don't go through compaction."""
    order = sorted(rows)
    digests = np.frombuffer(b"".join(order), np.uint8).reshape(-1, 32)
    column = lambda k: np.array([k(rows[d]) for d in order], np.int64)
    out = list(_blocks(run, digests, column(lambda x: x[1]), column(lambda x: x[2]), column(lambda x: len(x[3])), np.ones(len(order), np.int32), buckets, slots))
    for d in order:
        out.append({"run": run, "digest": d, "ids": rows[d][3]})
    return out


#: An id that orders a null doc_id before all others.
NULL_ID = -(1 << 63)


def _merged(pdf: pd.DataFrame):
    """All blocks of a bucket as one: which block each digest is of, the digests, and arrays of what each keeps.

    Digests that only one block's filter may hold pass as they are, the others are merged by value. Returns the rows of
    all blocks (block, digest, first of its group, keep_len, keep_id, n, times), where the last four are the group's.
    """
    blocks = pdf.to_dict("records")
    slots = blocks[0]["slots"]
    parts = [np.frombuffer(r["digests"], np.uint8).reshape(-1, 32) for r in blocks]
    held = np.zeros(slots, np.int32)
    for r, d in zip(blocks, parts, strict=True):
        held += np.unpackbits(np.frombuffer(r["filter"], np.uint8), count=slots) if r["filter"] is not None else _filter(np.ascontiguousarray(d), slots)
    digests = np.concatenate(parts)
    block = np.repeat([r["run"] for r in blocks], [len(d) for d in parts])
    length, keep, n, times = (np.concatenate([r[c] for r in blocks]).astype(np.int64) for c in ("keep_len", "keep_id", "n", "times"))
    head = np.ones(len(digests), bool)
    again = np.flatnonzero((held[_probes(np.ascontiguousarray(digests), slots)] >= 2).all(axis=1))
    if len(again):
        words = np.ascontiguousarray(digests[again]).view(">u8")
        order = np.lexsort((keep[again], -length[again], words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
        at, words = again[order], words[order]
        first = np.r_[True, (words[1:] != words[:-1]).any(axis=1)]
        starts, group = np.flatnonzero(first), np.cumsum(first) - 1
        head[at] = first
        length[at], keep[at] = length[at[starts]][group], keep[at[starts]][group]
        n[at], times[at] = np.add.reduceat(n[at], starts)[group], np.add.reduceat(times[at], starts)[group]
    return block, digests, head, length, keep, n, times


def compact(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blocks of a bucket in one group of runs as one block of one run, with the group's number."""
    _, digests, head, length, keep, n, times = _merged(pdf)
    at = np.flatnonzero(head)
    words = np.ascontiguousarray(digests[at]).view(">u8")
    at = at[np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0]))]
    bucket, slots = int(pdf["bucket"].iloc[0]), int(pdf["slots"].iloc[0])
    raw, bits = np.ascontiguousarray(digests[at]), None
    if slots // 8 <= raw.size:
        bits = np.packbits(_filter(raw, slots)).tobytes()
    return pd.DataFrame({"run": [int(pdf["grp"].iloc[0])], "bucket": [bucket], "slots": [slots], "filter": [bits], "digests": [raw.tobytes()], "keep_len": [length[at]], "keep_id": [keep[at]], "n": [n[at]], "times": [times[at].astype(np.int32)]})


def settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last compaction of a bucket: for each digest of each run (or group of runs) what the whole group keeps."""
    block, digests, _, _, keep, n, times = _merged(pdf)
    raw = digests.tobytes()
    return pd.DataFrame({"digest": [raw[32 * i : 32 * i + 32] for i in range(len(n))], "grp": block, "keep_id": keep, "group_size": n, "runs": times.astype(np.int32)})


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", memtable_bytes: int = MEMTABLE_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """The compacted index: a row for each document with its digest, the representative of its run, and the document that stays.

    Every task keeps a memtable of digests. A document that hits one is compared byte by byte with the text held there;
    equal ones become members, so a digest goes to the shuffle once for each run, however many copies there are. (Two
    texts of one digest in a run get entries under separate runs.) Each run is sorted and has a filter for each bucket.

    Members stay in a table by run and digest, one row for each pair, and never go through a compaction. More than
    fan_in runs are compacted in groups of about a root of their number first, so that neither a compaction nor the join
    with the members has more rows of one digest than that.
    """
    rows = docs.count()
    buckets = min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS), 8 if rows > 1000 else 1))
    slots = 1 << max(10, (rows * FILTER_BITS // buckets).bit_length())

    def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        table: dict = {}
        held = 0
        for batch in batches:
            for step in steps(batch):
                for i, t in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist(), strict=True):
                    body = normalised(t)
                    digest = hashlib.sha256(body).digest()
                    at = NULL_ID if i is None else i
                    x = table.get(digest)
                    if x is not None and x[0] != body:
                        yield pa.RecordBatch.from_pylist(flush(run, table, buckets, slots), _RUN)
                        table, held, run, x = {}, 0, run + 1, None
                    if x is None:
                        table[digest] = [body, len(t), at, [i]]
                        held += len(body) + 200
                    else:
                        if (-len(t), at) < (-x[1], x[2]):
                            x[1], x[2] = len(t), at
                        x[3].append(i)
                        held += 40
                    if held >= memtable_bytes:
                        yield pa.RecordBatch.from_pylist(flush(run, table, buckets, slots), _RUN)
                        table, held, run = {}, 0, run + 1
        if table:
            yield pa.RecordBatch.from_pylist(flush(run, table, buckets, slots), _RUN)

    runs = saved(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(memtables, _RUN_SQL), "lsm-runs")
    blocks = runs.filter("bucket is not null").select(*[c.split()[0] for c in _BLOCK_SQL.split(", ")])
    members = runs.filter("digest is not null").select("run", "digest", "ids")
    many = blocks.select("run").distinct().count()
    grp = F.col("run")
    if many > fan_in:
        grp = F.pmod(F.xxhash64("run"), F.lit(math.isqrt(many) + 1))
        blocks = blocks.withColumn("grp", grp).groupBy("bucket", "grp").applyInPandas(compact, _BLOCK_SQL)
    entries = blocks.groupBy("bucket").applyInPandas(settle, _ENTRY)
    out = members.withColumn("grp", grp).join(entries, ["digest", "grp"])
    # the run's own representative is only needed to find its text again: any member has it, the first one stands for all
    out = out.select("digest", "keep_id", "group_size", "runs", F.posexplode("ids").alias("at", "doc_id"))
    return out.select("doc_id", "digest", (F.col("at") == 0).alias("rep"), "keep_id", "group_size", "runs")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when the same after all of [\\x20\\x09-\\x0D] is deleted; null counts as empty. Of equal texts the row
    with most code points, then the smallest doc_id stays. A null doc_id orders before all and is returned as null.
    Rows that repeat a doc_id are rows of their own; of those that repeat the kept one's id and text, all count as kept.
    An empty table gives an empty one; other columns aren't read.

    Digests that occur in more than one run are hits: their representatives' texts, found in a second scan, are grouped
    by digest and bytes. One class for each digest proves the group; a digest with more (never seen) is settled by text.
    """
    entries = saved(index(docs, key, text), "lsm")
    hits = entries.filter("runs > 1 and rep").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "digest").distinct()
    body = F.translate(text_of(text), "\x20\x09\x0a\x0b\x0c\x0d", "")
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))
    wanted = _filtered(docs.select(ids.alias("doc_id"), body.alias("body")), hits, "doc_id")
    texts = wanted.join(hits, "doc_id").filter(F.unhex(F.sha2("body", 256)) == F.col("digest"))
    classes = texts.groupBy("digest", "body").agg(F.lit(1).alias("one"))
    clash = classes.groupBy("digest").agg(F.count("*").alias("classes")).filter("classes > 1").select("digest")
    out = entries.select("doc_id", "keep_id", "group_size", (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("keep_id")).alias("kept"), "digest")
    clash = saved(clash, "lsm-clash")
    if not clash.isEmpty():
        out = out.join(clash, "digest", "left_anti").unionByName(_by_text(docs, clash, key, text))
    return out.select(
        "doc_id", F.when(F.col("keep_id") != NULL_ID, F.col("keep_id")).alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


#: Bits of the filter that limits the second scan. Its table has FILTER_WORDS rows at most, a bound that no input moves.
FILTER_WORDS = 1 << 17


def _filtered(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be in wanted: a bitmap of FILTER_WORDS longs is broadcast, the rest is never shuffled."""
    slot = lambda: F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    word = wanted.select(slot().alias("s")).groupBy(F.floor(F.col("s") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("_bits"))
    marked = rows.withColumn("_s", slot()).withColumn("_word", F.floor(F.col("_s") / 64))
    return marked.join(F.broadcast(word), "_word").filter("(shiftrightunsigned(_bits, cast(_s % 64 as int)) & 1) = 1").drop("_s", "_word", "_bits")


def _by_text(docs: DataFrame, digests: DataFrame, key: str, text: str) -> DataFrame:
    """The same answer for the given digests from the texts themselves."""
    body = F.translate(text_of(text), "\x20\x09\x0a\x0b\x0c\x0d", "")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("body"), F.char_length(text_of(text)).alias("len"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256))).join(digests, "digest", "left_semi")
    best = rows.groupBy("digest", "body").agg(F.min(F.struct(-F.col("len"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id")))["id"].alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(best, ["digest", "body"]).select("doc_id", "keep_id", "group_size", (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("keep_id")).alias("kept"), "digest")

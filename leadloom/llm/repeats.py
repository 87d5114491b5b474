"""Long verbatim repeats across a corpus, by run-length indexes of the places that can repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SpanHash, flat, merged, mix64, steps, text_of
from leadloom.llm.exact_dedup import NULL_ID

#: Bytes of a repeat, and of the grams whose least hash in it is its anchor.
LENGTH, GRAM = 100, 32
#: Fingerprints in a bucket of the first count, about, and the most buckets.
BUCKET_PRINTS, MOST_BUCKETS = 1 << 20, 1 << 16
#: Bits of the filter of repeated anchors: 8 for each anchor up to this bound (128 MB), which no input moves.
MOST_BITS = 1 << 30
#: Places of one anchor from which its windows are dealt out one by one, and the bits of the filter of such anchors at most (16 MB).
HOT_PLACES, HOT_BITS = 5_000, 1 << 27
#: Bytes of places that a task holds to join equal ones before the shuffle, and that one index takes.
HELD_BYTES, INDEX_BYTES = 48 << 20, 2 << 20


class Windows:
    """The windows of LENGTH bytes of the rows of a text column, in runs of neighbours with one anchor.

    A window's anchor is the gram with the least hash in it (the first of equal ones), so equal windows have equal
    anchors at equal distances, wherever they are. data: all bytes; bounds: where rows start. For run r, starts[r] and
    stops[r] bound its bytes (its last window ends at stops[r]), row[r] is its row, prints[r] its anchor's hash.
    """

    def __init__(self, text: pa.Array, length: int = LENGTH, gram: int = GRAM):
        self.data, self.bounds = flat(text)
        n, grams = len(self.data), length - gram + 1
        none = np.zeros(0, np.int64)
        self.starts, self.stops, self.row, self.prints = none, none, none, none.astype(np.uint64)
        if n < length:
            return
        at = np.arange(n - gram + 1)
        hashes = SpanHash(self.data).of(at, at + gram)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        width = 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if grams > width:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, np.int32)
        lengths = np.diff(self.bounds)
        long = lengths >= length
        np.add.at(inside, self.bounds[:-1][long], 1)
        np.add.at(inside, self.bounds[1:][long] - length + 1, -1)
        valid = np.cumsum(inside)[: len(anchor)] > 0
        change = np.ones(len(anchor) + 1, bool)
        change[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        change[self.bounds[self.bounds < len(anchor)]] = True
        cuts = np.flatnonzero(change)
        keep = valid[cuts[:-1]]
        self.starts, self.stops = cuts[:-1][keep], cuts[1:][keep] - 1 + length
        self.row = np.searchsorted(self.bounds, self.starts, "right") - 1
        self.prints = mix64(hashes[anchor[self.starts]] + np.array([1], np.uint64))  # anchors' hashes are small ones: spread them again


def _bucket(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _bit(prints: np.ndarray, bits: int) -> np.ndarray:
    """A slot of the filter; the slots of a bucket are neighbours."""
    return (((prints >> np.uint64(32)) * np.uint64(bits >> 16)) >> np.uint64(32)) * np.uint64(1 << 16) + (prints & np.uint64(0xFFFF))


def _in(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """1 for each fingerprint whose slot is set."""
    bit = _bit(prints, len(bitmap) * 8).astype(np.int64)
    return bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1


def repeated_anchors(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(filter of the anchors that occur more than once, filter of those that occur HOT_PLACES times or more), from the anchors of all texts.

    Fingerprints travel packed, by bucket, each with its count in a step, so that a hot one is an entry a step; each
    bucket is counted in one task. What comes back are two bitmaps whose sizes are bounded. An anchor that only shares a
    slot with a hot one is treated as hot, which changes nothing in the result.
    """
    anchors = max(1, size * 2 // (LENGTH - GRAM))
    buckets = int(min(MOST_BUCKETS, max(8, 1 << (anchors // BUCKET_PRINTS).bit_length())))
    bits = int(min(MOST_BITS, max(1 << 20, 1 << (8 * anchors).bit_length())))
    hot_bits = min(HOT_BITS, bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                prints, n = np.unique(Windows(step.column("text")).prints, return_counts=True)
                bucket, n = _bucket(prints, buckets), np.minimum(n, HOT_PLACES).astype("<u2")
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(prints) else np.zeros(1, np.int64)
                own = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([prints[a:b].tobytes() for a, b in own], pa.binary()), pa.array([n[a:b].tobytes() for a, b in own], pa.binary())], ["bucket", "prints", "n"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, counts = None, [], []
        out = []

        def done() -> None:
            prints, back = np.unique(np.frombuffer(b"".join(held), np.uint64), return_inverse=True)
            n = np.bincount(back, np.frombuffer(b"".join(counts), "<u2"))
            out.append((own, _as_bitmap(own, _bit(prints[n > 1], bits), buckets, bits), _as_bitmap(own, _bit(prints[n >= HOT_PLACES], hot_bits), buckets, hot_bits)))

        for batch in batches:
            for k, p, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "prints", "n")), strict=True):
                if k != own and held:
                    done()
                    held, counts = [], []
                own = k
                held.append(p)
                counts.append(n)
        if held:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "marks", "hot"])

    packed = texts.select("text").mapInArrow(pack, "bucket int, prints binary, n binary")
    counted = packed.repartition(min(buckets, 2048), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "bucket int, marks binary, hot binary")
    found = [(np.zeros(n // 8, np.uint8), n) for n in (bits, hot_bits)]
    for r in counted.toLocalIterator():
        for (out, n), part in zip(found, (r["marks"], r["hot"]), strict=True):
            a, b = _bytes_of(r["bucket"], buckets, n)
            out[a:b] |= np.frombuffer(bytes(part), np.uint8)
    return found[0][0], found[1][0]


def _bytes_of(bucket: int, buckets: int, bits: int) -> tuple[int, int]:
    """The bytes of the filter that a bucket's slots fall into."""
    low = (bucket << 32) // buckets
    high = -(-((bucket + 1) << 32) // buckets)
    pages = bits >> 16
    return (low * pages >> 32) << 13, min(((high * pages >> 32) + 1) << 13, bits // 8)


def _as_bitmap(bucket: int, marked: np.ndarray, buckets: int, bits: int) -> bytes:
    a, b = _bytes_of(bucket, buckets, bits)
    flags = np.zeros((b - a) * 8, bool)
    flags[marked.astype(np.int64) - a * 8] = True
    return np.packbits(flags, bitorder="little").tobytes()


class RunLengthIndex:
    """Suffixes of a text in order of their first LENGTH bytes, as runs of the Burrows-Wheeler transform with sampled ends.

    A run is a stretch of that order whose suffixes share their first LENGTH bytes and the byte before them; of each
    run only its length and its first (earliest) suffix are kept. starts: the suffixes that matter.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, length: int = LENGTH):
        n = len(text)
        padded = np.concatenate([text, np.zeros(2 * length, np.uint8)])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : n + k]
        rank, width = self._ranks(key), 8
        while width < length:
            step = min(width, length - width)
            beyond = np.zeros(n, np.uint64)
            beyond[: n - step] = rank[step:] + np.uint64(1)
            rank = self._ranks((rank << np.uint64(32)) | beyond)
            width += step
        order = np.argsort(rank[starts], kind="stable")
        suffix = starts[order]
        same = rank[suffix]
        before = np.where(suffix > 0, text[np.maximum(suffix - 1, 0)], 0)
        fresh = np.r_[True, (same[1:] != same[:-1]) | (before[1:] != before[:-1])]
        self.heads = np.flatnonzero(fresh)
        self.sizes = np.diff(np.r_[self.heads, len(suffix)])
        self.letters = before[self.heads]
        self.samples = suffix[self.heads]
        self.classes = np.cumsum(np.r_[True, same[self.heads][1:] != same[self.heads][:-1]]) - 1
        self.suffix = suffix

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        out = np.empty(len(key), np.uint64)
        out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]).astype(np.uint64)
        return out

    def sources(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes, and for each the earliest one that matches it over LENGTH bytes: the least sample of the runs of its class."""
        first = np.flatnonzero(np.r_[True, self.classes[1:] != self.classes[:-1]])
        earliest = np.minimum.reduceat(self.samples, first)
        return self.suffix, np.repeat(earliest[self.classes], self.sizes)


def _index_group(rows: list[tuple], out: list[tuple]) -> None:
    """Repeats among places (doc, th, start, bytes) of several anchors, each in order of document and start: appends (doc, th, from, to)."""
    if not rows:
        return
    sizes = np.array([len(r[3]) for r in rows])
    base = np.cumsum(np.r_[0, sizes])
    text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix, source = RunLengthIndex(text, base[owner] + offset).sources()
    earliest = np.zeros(len(text), np.int64)
    earliest[suffix] = source
    at = earliest[base[owner] + offset]
    there = np.searchsorted(base, at, "right") - 1
    doc, start = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    mine, theirs = start[owner] + offset, start[there] + at - base[there]
    again = (doc[there] < doc[owner]) | ((doc[there] == doc[owner]) & (theirs < mine))
    edge = np.flatnonzero(np.r_[True, (again[1:] != again[:-1]) | (owner[1:] != owner[:-1]), True])
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if again[a]:
            r = rows[owner[a]]
            out.append((r[0], r[1], int(mine[a]), int(mine[b - 1]) + LENGTH))


_PLACE = pa.schema([("slot", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("body", pa.binary())])
_SPAN = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeat_spans(texts: DataFrame) -> DataFrame:
    """(doc, th, start, stop): byte ranges made of windows that occur earlier. texts: doc, th (a hash of the text), text.

    1. Anchors of all windows are counted; a bitmap of those that occur again is broadcast.
    2. Each task cuts the places that have such anchors. Equal places in a task are one: the earliest goes on, the
       others are repeats. An anchor with very many places goes on window by window, so that no task gets them all.
    3. Places meet by anchor. Equal ones are settled as before; the rest of an anchor with several different ones goes
       into a run-length index, whose classes of equal windows have their earliest place sampled at run ends.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeated = texts.sparkSession.sparkContext.broadcast(repeated_anchors(texts, size))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, hot = repeated.value
        held: dict[bytes, tuple] = {}
        volume, done = 0, []

        def put(body: bytes, slot: int, doc: int, th: int, start: int) -> None:
            nonlocal volume
            x = held.get(body)
            if x is None:
                held[body] = (slot, doc, th, start)
                volume += len(body) + 150
            elif (doc, start) < (x[1], x[3]):
                held[body] = (slot, doc, th, start)
                done.append((x[1], x[2], x[3], x[3] + len(body)))
            elif (doc, start) > (x[1], x[3]):
                if done and done[-1][:2] == (doc, th) and done[-1][2] <= start <= done[-1][3]:
                    done[-1] = (doc, th, done[-1][2], max(done[-1][3], start + len(body)))
                else:
                    done.append((doc, th, start, start + len(body)))

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal volume
            yield _batch([(s, d, t, a, a + len(b), b) for b, (s, d, t, a) in held.items()], _PLACE)
            yield _batch([(d ^ t, d, t, a, b, None) for d, t, a, b in done], _PLACE)
            held.clear()
            done.clear()
            volume = 0

        for batch in batches:
            for step in steps(batch):
                w = Windows(step.column("text"))
                take = np.flatnonzero(_in(marks, w.prints))
                often = _in(hot, w.prints[take]) > 0
                docs, ths = step.column("doc").to_numpy(), step.column("th").to_numpy()
                raw = w.data.tobytes()
                row = w.row[take]
                lines = zip(w.starts[take].tolist(), w.stops[take].tolist(), w.prints[take].view(np.int64).tolist(), docs[row].tolist(), ths[row].tolist(), w.bounds[row].tolist(), often.tolist(), strict=True)
                spans = SpanHash(w.data) if often.any() else None
                for a, b, slot, doc, th, base, many in lines:
                    if many:
                        at = np.arange(a, b - LENGTH + 1)
                        for p, s in zip(at.tolist(), spans.of(at, at + LENGTH).view(np.int64).tolist(), strict=True):
                            put(raw[p : p + LENGTH], s, doc, th, p - base)
                    else:
                        put(raw[a:b], slot, doc, th, a - base)
                    if volume >= HELD_BYTES or len(done) >= 500_000:
                        yield from flushed()
        yield from flushed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, group, seen = None, [], {}
        ready: list[tuple] = []
        volume = 0
        for batch in batches:
            out: list[tuple] = []
            for s, doc, th, start, stop, body in zip(*(batch.column(c).to_pylist() for c in _PLACE.names), strict=True):
                if body is None:
                    out.append((doc, th, start, stop))
                    continue
                if s != slot:
                    if len(group) > 1:
                        ready += group
                        volume += sum(len(r[3]) for r in group)
                        if volume >= INDEX_BYTES:
                            _index_group(ready, out)
                            ready, volume = [], 0
                    slot, group, seen = s, [], {}
                x = seen.get(body)
                if x is None:
                    seen[body] = (doc, start)
                    group.append((doc, th, start, body))
                elif (doc, start) > x:
                    out.append((doc, th, start, stop))
            yield _batch(out, _SPAN)
        out = []
        _index_group(ready + (group if len(group) > 1 else []), out)
        yield _batch(out, _SPAN)

    found = texts.mapInArrow(places, "slot long, doc long, th long, start long, stop long, body binary")
    return found.repartition("slot").sortWithinPartitions("slot", "doc", "start").mapInArrow(meet, "doc long, th long, start long, stop long")


def _keyed(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    body = text_of(text)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(body).alias("th"), body.alias("text"), *more)


def _with_spans(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    spans = repeat_spans(_keyed(docs, key, text)).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return _keyed(docs, key, text, *more).join(spans, ["doc", "th"], "left")


def mark_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes when a LENGTH-byte string over it also starts earlier: in a smaller doc_id, or before it in its own.
    Strings are of the input, whole texts in UTF-8, null as empty, and never cross documents. A null doc_id is the
    smallest. Rows that repeat a doc_id are rows of their own, neither before the other: their equal positions don't
    remove each other. An empty table gives an empty one; other columns aren't read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                rows = []
                for doc, t, spans in zip(step.column("doc").to_pylist(), step.column("text").to_pylist(), step.column("spans").to_pylist(), strict=True):
                    body, kept, at = t.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                    cut = merged([(s["start"], s["stop"]) for s in spans or ()])
                    for a, b in zip(cut[::2], cut[1::2], strict=True):
                        kept.update(body[at:a])
                        at = b
                    kept.update(body[at:])
                    rows.append((None if doc == NULL_ID else doc, len(body), sum(cut[1::2]) - sum(cut[::2]), len(cut) // 2, kept.hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                )

    rows = _with_spans(docs, key, text).select("doc", "text", "spans")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes gone from the text; bytes of a character that was cut through are dropped."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                body, parts, at = t.encode("utf-8", "surrogatepass"), [], 0
                found = merged([(s["start"], s["stop"]) for s in spans or ()])
                for a, b in zip(found[::2], found[1::2], strict=True):
                    parts.append(body[at:a])
                    at = b
                texts.append(b"".join([*parts, body[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("row")], ["text", "row"])

    rows = _with_spans(docs, key, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    kind = dict(rows.dtypes)["row"]
    out = rows.select("text", "spans", "row").mapInArrow(cut, f"text string, row {kind}")
    return out.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns])

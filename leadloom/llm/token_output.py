"""Token ids in compressed binary units, and reading them back."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm import context_coder
from leadloom.llm.common import flat, steps, text_of, tidy
from leadloom.shared import shared_path

#: The id that ends each document, ids of a unit (as many as are coded side by side), text bytes of a step, pieces whose ids a worker remembers.
END_ID, UNIT_IDS, TOKEN_STEP, REMEMBERED = 2, context_coder.LANES * context_coder.BLOCK, 512 << 10, 800_000
# The head of a unit and of its tables.
MAGIC, HEAD = b"TKC2", struct.Struct("<4sIQII")


#: Kinds of bytes: blank, letter, numeral, other, apostrophe, and what isn't ASCII or a printed character.
_KIND = np.full(256, 5, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 4
#: Whether a piece ends between a byte of one kind and a byte of the next.
_ENDS = np.array([k in ((1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (4, 2)) for k in np.ndindex(6, 6)])
#: Bytes of a short piece, which stands in the table as two numbers; slots of that table; bytes of a piece that isn't remembered.
SHORT, SLOTS, LONG = 16, 1 << 22, 256
#: A pre-token as it stands: ASCII of one kind, or letters of ranges that have been all letters in every version of Unicode.
PLAIN = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u0513]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")
# How byte-level vocabularies spell bytes. Printed ones of Latin-1 stand for themselves, the others for what follows.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = dict(zip(_PRINTED, map(chr, _PRINTED), strict=True)) | {c: chr(256 + k) for k, c in enumerate(sorted({*range(256)}.difference(_PRINTED)))}
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, and where ASCII letters, numerals, other characters and blanks surely meet.

    A byte-level tokenizer's pre-tokens never go from one of these kinds into another, but for a single space before, and
    for letters after an apostrophe; none looks further back than where it starts.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    np.take(_ENDS, kind[:-1] * np.uint8(6) + kind[1:], out=cut[1:])
    # before a blank there may be one beyond ASCII, or a control character that some call one
    odd = np.flatnonzero((kind[:-1] == 5) & cut[1:]) + 1
    if len(odd):
        last = [data[np.maximum(odd - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        two, three = last[1] << 8 | last[0], last[2] << 16 | last[1] << 8 | last[0]
        doubt = (last[0] < 0x20) | (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | (three >= 0xE28080) & (three <= 0xE280AF) | (three == 0xE2819F) | (three == 0xE38080)
        cut[odd[doubt]] = False
    cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return cut


class Tokens:
    """Ids of whole texts from a tokenizer of the tokenizers library with byte-level pieces and ids below 65,536.

    Texts are cut where a blank follows something else: no pre-token goes across. Pieces, most of which recur, are
    encoded once; a table finds them by their bytes. A special token that a text spells out is text like any other, or
    with special=True has its own id, as in a plain call of the tokenizer.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already share the machine
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        #: texts that spell one of these out are encoded whole and alone
        self.spelled = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) > 0xFFFF:
            raise ValueError("token ids of 65,536 and more aren't written")
        self.forget()

    def forget(self) -> None:
        """Empties the tables. Pieces are numbered; ids[first : first + size] are a piece's."""
        self.long: dict[bytes, int] = {}
        self.pieces, self.filled = 0, 0
        self.ids = np.zeros(1 << 20, np.uint16)
        self.first, self.size = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.low, self.high, self.length = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.uint8)
        self.slots = np.full(SLOTS, -1, np.int32)

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0xD6E8FEB86659FD93)) ^ length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 22)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of short pieces, -1 for new ones."""
        slot = self._slot(low, high, length)
        found = self.slots[slot].astype(np.int64)
        wrong = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high) | (self.length[found] != length)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (SLOTS - 1)
            again = self.slots[slot[wrong]].astype(np.int64)
            found[wrong] = again
            wrong = wrong[(again >= 0) & ((self.low[again] != low[wrong]) | (self.high[again] != high[wrong]) | (self.length[again] != length[wrong]))]
        return found

    def _put(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, number: np.ndarray) -> None:
        """New short pieces, each once, into the table."""
        self.low[number], self.high[number], self.length[number] = low, high, length
        slot, left = self._slot(low, high, length), np.arange(len(number))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = number[free]
            left = left[self.slots[slot[left]] != number[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers for new pieces. One that is a pre-token as it stands goes to the tokenizer's model, the others through all of the tokenizer."""
        match, model, texts = PLAIN.fullmatch, self.tokenizer.model.tokenize, [p.decode() for p in pieces]
        plain = [match(t) is not None for t in texts]
        other = iter(self.tokenizer.encode_batch_fast([t for t, k in zip(texts, plain, strict=True) if not k], add_special_tokens=False))
        found = [[t.id for t in model(p.decode("latin-1").translate(_SPELLING))] if k else next(other).ids for p, k in zip(pieces, plain, strict=True)]
        number = np.arange(self.pieces, self.pieces + len(pieces))
        self._keep(number, np.array([i for f in found for i in f], np.uint16), np.array([len(f) for f in found], np.int64))
        self.pieces += len(pieces)
        return number

    def _keep(self, number: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(number) and number.max() >= len(self.first):
            self.first, self.size, self.low, self.high, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.low, self.high, self.length))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.size[number] = sizes
        self.first[number] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)

    def of(self, texts, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many each text has (with the end id). texts: a large_string array without nulls, or a list."""
        if self.pieces > REMEMBERED or self.filled > 12 * REMEMBERED:
            self.forget()
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        data, bounds = flat(texts)
        raw = data.tobytes()
        cut = _cuts(data, bounds) if len(data) else np.zeros(0, bool)
        for token in self.spelled:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(bounds, at, "right")) - 1
                cut[bounds[k] + 1 : bounds[k + 1]] = False
                at = raw.find(token, bounds[k + 1])
        starts = np.flatnonzero(cut)
        length = np.diff(starts, append=len(data))
        number = np.full(len(starts), -1, np.int64)
        words = np.ndarray(len(data) + 1, "<u8", raw + bytes(SHORT), strides=(1,))
        short = np.flatnonzero(length <= SHORT)
        begin, own = starts[short], length[short]
        low = words[begin] & _MASKS[np.minimum(own, 8)]
        high = words[np.minimum(begin + 8, len(data))] & _MASKS[np.maximum(own - 8, 0)]
        found = self._find(low, high, own)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            order = np.lexsort((own[fresh], high[fresh], low[fresh]))
            by = [x[fresh][order] for x in (low, high, own)]
            first = np.flatnonzero(np.r_[True, (by[0][1:] != by[0][:-1]) | (by[1][1:] != by[1][:-1]) | (by[2][1:] != by[2][:-1])])
            new = fresh[order[first]]
            self._put(low[new], high[new], own[new], self._learn([raw[a : a + n] for a, n in zip(begin[new].tolist(), own[new].tolist(), strict=True)]))
            found[fresh] = self._find(low[fresh], high[fresh], own[fresh])
        number[short] = found
        others = np.flatnonzero(length > SHORT)
        if len(others):
            pieces = [raw[a : a + n] for a, n in zip(starts[others].tolist(), length[others].tolist(), strict=True)]
            unknown = list(dict.fromkeys(p for p in pieces if p not in self.long))
            known = self.long | dict(zip(unknown, self._learn(unknown).tolist(), strict=True)) if unknown else self.long
            number[others] = [known[p] for p in pieces]
            self.long.update((p, known[p]) for p in unknown if len(p) <= LONG)
        size = self.size[number].astype(np.int64)
        ends = np.cumsum(size)
        sizes = np.diff(np.concatenate([[0], ends])[np.searchsorted(starts, bounds)])
        out = np.empty(int(ends[-1] if len(ends) else 0) + (len(texts) if end is not None else 0), np.uint16)
        # where each piece's ids go: behind those before it and the end ids of earlier texts
        shift = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds))) if end is not None else 0
        put, take = ends - size + shift, self.first[number]
        for k in range(int(size.max(initial=0)) if len(size) else 0):
            more = np.flatnonzero(size > k) if k else slice(None)
            if k and len(more) < 64:
                for i in more.tolist():  # the few that are very long
                    out[put[i] + k : put[i] + size[i]] = self.ids[take[i] + k : take[i] + size[i]]
                break
            out[put[more] + k] = self.ids[take[more] + k]
        if end is None:
            return out, sizes
        out[np.cumsum(sizes + 1) - 1] = end
        return out, sizes + 1


_TOKENS: dict[tuple, Tokens] = {}


def tokens_of(path: str, special: bool = False) -> Tokens:
    """A worker process's own Tokens, which its tasks share."""
    if (path, special) not in _TOKENS:
        _TOKENS[path, special] = Tokens(path, special)
    return _TOKENS[path, special]


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A unit: documents' ids and sizes, then the token ids in blocks that are coded, and can be read, each alone."""
    blocks = context_coder.split(ids)
    coded = context_coder.encode(blocks)
    tables = b"".join(
        [
            np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], "u1").tobytes(), np.asarray(sizes, "<u4").tobytes(),
            np.array([len(b) for b in blocks], "<u4").tobytes(), np.array([len(c) for c in coded], "<u4").tobytes(), np.array([zlib.crc32(b.astype("<u2").tobytes()) for b in blocks], "<u4").tobytes(),
        ]
    )
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), zlib.crc32(tables)), tables, *coded])


def unpack(unit: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their sizes, and all token ids of a unit; raises ValueError if a checksum is wrong."""
    magic, docs, _, blocks, check = HEAD.unpack_from(unit)
    at = HEAD.size + 13 * docs + 12 * blocks
    if magic != MAGIC or zlib.crc32(unit[HEAD.size : at]) != check:
        raise ValueError("not a unit of token ids, or a damaged one")
    doc_ids, null, sizes, counts, lengths, sums = (
        np.frombuffer(unit, kind, count, HEAD.size + 13 * docs - before + 4 * blocks * k)
        for kind, count, before, k in (("<i8", docs, 13 * docs, 0), ("u1", docs, 5 * docs, 0), ("<u4", docs, 4 * docs, 0), ("<u4", blocks, 0, 0), ("<u4", blocks, 0, 1), ("<u4", blocks, 0, 2))
    )
    ends = at + np.cumsum(lengths.astype(np.int64))
    parts = [unit[b - k : b] for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
    try:
        found = context_coder.decode(parts, counts.tolist())
    except (IndexError, ValueError) as e:
        raise ValueError("a damaged block of token ids") from e
    for b, c in zip(found, sums.tolist(), strict=True):
        if zlib.crc32(b.astype("<u2").tobytes()) != c:
            raise ValueError("a damaged block of token ids")
    return [None if x else i for i, x in zip(doc_ids.tolist(), null.tolist(), strict=True)], sizes.astype(np.int64), np.concatenate(found) if found else np.zeros(0, np.uint16)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", unit_ids: int = UNIT_IDS, special: bool = False) -> None:
    """Token ids of all texts as units below path, in ascending order of doc_id (null first; equal ids by a hash of the text).

    path/part, seq order the units. Documents are dealt out by ranges of their ids; a unit takes steps while they fit into
    unit_ids (one with more is a unit alone), and a task holds one unit. Null texts are empty and have the end id alone.
    special: as for Tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, seq = tokens_of(tokenizer, special), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        volume = 0

        def unit():
            nonlocal seq, volume
            body = pack(doc_ids, np.concatenate(sizes), np.concatenate(held))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([volume], pa.int64()), pa.array([body], pa.binary())], ["part", "seq", "n_docs", "n_ids", "unit"])
            seq, volume = seq + 1, 0
            for x in (doc_ids, held, sizes):
                x.clear()
            return out

        for batch in batches:
            for step in steps(batch, limit=TOKEN_STEP):
                ids, own = tokens.of(step.column("text"))
                if doc_ids and volume + len(ids) > unit_ids:
                    yield unit()
                doc_ids += step.column("doc_id").to_pylist()
                held.append(ids)
                sizes.append(own)
                volume += len(ids)
        if doc_ids:
            yield unit()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    units = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), "part int, seq int, n_docs long, n_ids long, unit binary")
    units.write.option("parquet.block.size", 8 << 20).option("compression", "uncompressed").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and ids) of every document in the files.

    Where a unit starts is a running sum over the units of its part, and one over the parts; documents add what stands
    before them in their unit.
    """
    units = spark.read.schema("part int, seq int, n_docs long, n_ids long, unit binary").parquet(path)
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = units.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("start"))
    places = units.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("inside")).join(parts, "part").select("part", "seq", (F.col("start") + F.col("inside")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, body in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("unit"), strict=True):
                doc_ids, sizes, ids = unpack(body.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                names = ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    found = units.select("part", "seq", "unit").mapInArrow(tidy(run), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    out = found.join(places.select("part", "seq", "before"), ["part", "seq"]).withColumn("start", F.col("before") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str | None = None, special: bool = False) -> DataFrame:
    """The contract's columns, from files that were written and read again.

    Every row of docs is a document of its own, with its doc_id, also if that is null or repeats. An empty table gives
    no units and an empty result; columns other than doc_id and text aren't read. special: as for Tokens.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.json"))
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, special=special)
    return read_tokens(docs.sparkSession, path)

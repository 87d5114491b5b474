"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.shared import shared_path

#: Text bytes that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends there, and lost executors lose none of it.

    A table with a key once is written before rows with hot keys are joined with it: the join's inputs are then plain
    shuffles, whose large partitions adaptive execution splits, and a small table is broadcast up to Spark's own bound.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def hashed_groups(rows: DataFrame, key: str, order: list[str], piece: str, separator: str) -> DataFrame:
    """key and `sha256`: for each key the lowercase SHA-256 of its pieces, joined in the given order. A null key is a key.

    SHA-256 reads one byte after the other, so a key's pieces pass through one task; they stream through it in the order of
    Spark's sort, which spills, and only the hash's state is kept. Null pieces are empty.
    """
    joint = separator.encode()
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            keys, pieces, done = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, run in groupby(range(len(keys)), keys.__getitem__):
                text = joint.join((pieces[i] or "").encode() for i in run)
                if state is not None and k == at:
                    state.update(joint + text)
                    continue
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = k, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field(0).type), pa.array([h for _, h in done], pa.string())], [key, "sha256"])
            arrow = batch.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], arrow), pa.array([state.hexdigest()], pa.string())], [key, "sha256"])

    placed = rows.repartition(key).sortWithinPartitions(key, *order).select(key, piece)
    return placed.mapInArrow(run, f"`{key}` {kind.simpleString()}, sha256 string")


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, whole rows each; null texts become empty."""
    text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    batch = batch.set_column(batch.schema.get_field_index(column), column, text)
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns the memory that Arrow and, where it is glibc, the C library hold free to the machine, and SpanHash's powers."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, for mapInArrow, so that its worker gives free memory back when a task ends.

    Spark keeps workers for later tasks, those of other stages too, and all that they hold counts as their executor's.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column in one array, and where each row starts (one more entry than rows)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers 0 .. n-1."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


class SpanHash:
    """Hashes of any spans of one byte array in constant time each, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])


def code_points(text: str, encoded: bytes, positions: list[int]) -> list[int]:
    """Byte positions of the encoded text as code point positions."""
    if len(text) == len(encoded):
        return positions
    out, at, count = {}, 0, 0
    for p in sorted(set(positions)):
        count += len(encoded[at:p].decode())
        out[p], at = count, p
    return [out[p] for p in positions]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Half-open spans as start, end, start, end ... without overlaps, in order."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out

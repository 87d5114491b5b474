"""Benchmark decontamination by suffix arrays of the training texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import SpanHash, merged, steps, text_of, tidy

WINDOW = 10
#: Benchmark text that one pass over the documents looks for; larger benchmarks take several.
BLOCK_BYTES = 8 << 20
#: Places with items that are compared at once, and matches in one batch that goes back.
PAIRS = 1 << 18
_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32()), ("n_places", pa.int32())]))


def words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


class TestSuffixes:
    """The suffixes of benchmark items, cut to one window each, grouped by window length, each distinct window once.

    An item of `window` words or more has a suffix for each window; a shorter one is a window as a whole.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids, numbers = [], []
        for item_id, text in items:
            own = words(text or "")
            if own:
                numbers.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own), np.int32, len(own)))
                self.item_ids.append(item_id)
        self.text = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        sizes = np.array([len(n) for n in numbers], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.lengths = {}
        for length in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            each = sizes[own] - length + 1
            item = np.repeat(own, each)
            at = np.repeat(self.starts[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
            rows = self.text[at[:, None] + np.arange(length)]
            keys, number = np.unique(_keys(rows), return_inverse=True)
            used = np.zeros(len(self.vocabulary) + 1, bool)
            used[rows] = True
            # the items of each distinct window, each once
            pairs = np.unique(number.astype(np.int64) * len(sizes) + item)
            self.lengths[length] = (keys, np.searchsorted(pairs // len(sizes), np.arange(len(keys) + 1)), pairs % len(sizes), used)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that order as the rows do."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 .. (counts[0] of them), starts[1] ..."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class _Ranks:
    """Ranks of a text's suffixes by their first 1, 2, 4 .. words, by prefix doubling, until `longest` words are covered."""

    def __init__(self, text: np.ndarray, longest: int):
        self.levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(self.levels) - 1) < longest:
            rank, step = self.levels[-1], 1 << (len(self.levels) - 1)
            beyond = np.zeros(len(rank), np.int64)
            beyond[: max(0, len(rank) - step)] = rank[step:] + 1
            self.levels.append(np.unique(rank * (len(rank) + 2) + beyond, return_inverse=True)[1].astype(np.int64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words suffixes a[i] and b[i] share."""
        n, last = np.zeros(len(a), np.int64), len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            same = (np.maximum(a, b) + n <= last) & (self.levels[k][np.minimum(a + n, last)] == self.levels[k][np.minimum(b + n, last)])
            n += same << k
        return n


class _Located:
    """Where the windows of items occur in a shard, and the hit words and the items met ranked together.

    ids: word numbers of the shard's documents in turn, 0 for a word that no item has; starts: where documents start,
    and the end. The shard's suffix array holds, in the order of their next `length` words, the suffixes that can match:
    those whose words occur in items, in one document. Every distinct test window is binary-searched in it; the range
    found are its locations, so each location comes up once, however often words repeat. A location's items are a range
    (first, many) of `items`; they aren't written out for each location.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, suffixes: TestSuffixes):
        self.ids, self.starts = ids, starts
        change = np.zeros(len(ids) + 1, np.int64)
        self.document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        none = np.zeros(0, np.int64)
        place, first, many, self.items = [none], [none], [none], none
        for length, (keys, bounds, item, used) in suffixes.lengths.items():
            run = np.concatenate([[0], np.cumsum(used[ids])])
            at = np.flatnonzero(run[length:] - run[:-length] == length) if len(ids) >= length else none
            at = at[starts[self.document[at] + 1] - at >= length]
            if not len(at):
                continue
            array = _keys(ids[at[:, None] + np.arange(length)])
            order = np.argsort(array, kind="stable")
            array, at = array[order], at[order]
            low, high = np.searchsorted(array, keys, "left"), np.searchsorted(array, keys, "right")
            met = np.flatnonzero(high > low)
            found = at[_spread(low[met], (high - low)[met])]
            window = np.repeat(met, (high - low)[met])
            change[found] += 1
            change[found + length] -= 1
            place.append(found)
            first.append(bounds[window] + len(self.items))
            many.append((bounds[1:] - bounds[:-1])[window])
            self.items = np.concatenate([self.items, item])
        self.hit = np.cumsum(change[:-1]) > 0
        self.place, self.first, self.many = map(np.concatenate, (place, first, many))
        if len(self.place):
            self._rank(suffixes)

    def _rank(self, suffixes: TestSuffixes) -> None:
        # the hit words and the items that were met as one text; a word in between ends every match
        ids, starts = self.ids, self.starts
        ranges = np.unique(np.stack([self.first, self.many], 1), axis=0)
        known = np.unique(self.items[_spread(ranges[:, 0], ranges[:, 1])])
        sizes = np.diff(suffixes.starts)[known]
        inside = np.flatnonzero(self.hit)
        apart = np.cumsum((np.diff(inside, prepend=-2) > 1) | np.isin(inside, starts)) - 1
        text = np.zeros(len(inside) + (apart[-1] + 1) + sizes.sum() + len(sizes), np.int64)
        self.spot = np.zeros(len(ids), np.int64)
        self.spot[inside] = np.arange(len(inside)) + apart
        text[self.spot[inside]] = ids[inside]
        base = len(inside) + (apart[-1] + 1) + np.cumsum(sizes + 1) - sizes - 1
        text[_spread(base, sizes)] = suffixes.text[_spread(suffixes.starts[known], sizes)]
        text[base + sizes] = -1
        # where the run of hit words that a word is in ends
        last = np.append(np.flatnonzero(np.diff(apart)), len(inside) - 1)
        self.run_end = np.zeros(len(ids), np.int64)
        self.run_end[inside] = inside[last[apart]] + 1
        self.ranks = _Ranks(text, int(sizes.max()))
        own = np.repeat(np.arange(len(known)), sizes)
        theirs, rank = _spread(base, sizes), self.ranks.levels[-1]
        order = np.lexsort((theirs, rank[theirs], own))
        self.theirs, self.wide = theirs[order], len(text) + 1
        self.keys = (own * self.wide + rank[theirs])[order]
        self.known, self.base, self.ends, self.sizes = known, base, np.cumsum(sizes), sizes

    def longest(self, place: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place and item the most words that they share from the place on, and the item's word at which that starts.

        Of an item, the suffixes next to a location in rank share most with it.
        """
        k, here, rank = np.searchsorted(self.known, item), self.spot[place], self.ranks.levels[-1]
        after = np.searchsorted(self.keys, k * self.wide + rank[here])
        best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for beside in (after - 1, after):
            able = (beside >= (self.ends - self.sizes)[k]) & (beside < self.ends[k])
            other = self.theirs[np.clip(beside, 0, len(self.theirs) - 1)]
            n = np.where(able, self.ranks.common(here, other), 0)
            better = n > best
            best, where = np.where(better, n, best), np.where(better, other - self.base[k], where)
        return best, where


def search_shard(ids: np.ndarray, starts: np.ndarray, suffixes: TestSuffixes):
    """(hit, matches) of a shard: which words are hit, and rows (document, document word, item, item word, longest match).

    All matches of all locations are written out; a match inside another one of its item isn't given.
    """
    found = _Located(ids, starts, suffixes)
    if not len(found.place):
        return found.hit, np.zeros((0, 5), np.int64)
    pairs = np.unique(found.items[_spread(found.first, found.many)] * len(ids) + np.repeat(found.place, found.many))
    place, item = pairs % len(ids), pairs // len(ids)
    best, where = found.longest(place, item)
    # pairs are in order of item and place: a match that ends no later than one before it is inside that one
    end = item * (len(ids) + 1) + place + best
    keep = np.concatenate([[True], end[1:] > np.maximum.accumulate(end)[:-1]])
    place, item, best, where = place[keep], item[keep], best[keep], where[keep]
    return found.hit, np.stack([found.document[place], place - starts[found.document[place]], item, where, best], 1)


def longest_matches(ids: np.ndarray, starts: np.ndarray, suffixes: TestSuffixes, limit: int = PAIRS):
    """(hit, matches) with one row for each document and item: document, document word, item, item word, words, places.

    The longest match, the first in the document of equal ones, and at how many places windows of the item stand. Places
    of one document whose words go on alike to the end of what is hit count as one, so that a template's many
    occurrences aren't compared with its many items one by one; pairs are written out for some places at a time.
    """
    found = _Located(ids, starts, suffixes)
    if not len(found.place):
        return found.hit, np.zeros((0, 6), np.int64)
    alike = SpanHash(ids).of(found.place, found.run_end[found.place])
    order = np.lexsort((found.place, alike, found.first, found.document[found.place]))
    place, first, many, alike = found.place[order], found.first[order], found.many[order], alike[order]
    document = found.document[place]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(document) != 0) | (np.diff(first) != 0) | (alike[1:] != alike[:-1])]))
    count = np.diff(np.append(new, len(place)))
    place, first, many = place[new], first[new], many[new]
    ends, at, out = np.cumsum(many), 0, []
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        some = slice(at, stop)
        item, spot, n = found.items[_spread(first[some], many[some])], np.repeat(place[some], many[some]), np.repeat(count[some], many[some])
        best, where = found.longest(spot, item)
        out.append(_strongest(np.stack([found.document[spot], spot, item, where, best, n], 1)))
        at = stop
    rows = _strongest(np.concatenate(out))
    rows[:, 1] -= starts[rows[:, 0]]
    return found.hit, rows


def _strongest(rows: np.ndarray) -> np.ndarray:
    """Of rows (document, place, item, item word, words, places) those with most words of each document and item, places summed."""
    rows = rows[np.lexsort((rows[:, 1], -rows[:, 4], rows[:, 2], rows[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 2]) != 0)]))
    out = rows[new]
    out[:, 5] = np.add.reduceat(rows[:, 5], new)
    return out


def shard_matches(ids: np.ndarray, starts: np.ndarray, suffixes: TestSuffixes):
    """The matches of search_shard(), as tuples."""
    return map(tuple, search_shard(ids, starts, suffixes)[1].tolist())


def _appended(lists: pa.ListArray, owner: np.ndarray, rows: pa.Array) -> pa.ListArray:
    """The lists with each of the rows at the end of its owner's."""
    owners = np.concatenate([np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), owner])
    ends = np.cumsum(np.bincount(owners, minlength=len(lists)))
    values = pa.concat_arrays([lists.flatten(), rows]).take(pa.array(np.argsort(owners, kind="stable")))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _search(suffixes, window: int):
    """Arrow batches with the columns that suffix search of one benchmark block adds to or extends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = suffixes.value
        item_ids = pa.array(known.item_ids, pa.string())
        for batch in batches:
            for step in steps(batch):
                get, numbers, starts = known.vocabulary.get, [], [0]
                for t in step.column("text").to_pylist():
                    own = words(t)
                    numbers.append(np.fromiter(map(get, own, repeat(0)), np.int64, len(own)))
                    starts.append(starts[-1] + len(own))
                ids, starts = np.concatenate(numbers) if numbers else np.zeros(0, np.int64), np.array(starts)
                hit, matches = longest_matches(ids, starts, known)
                spans = step.column("spans").to_pylist()
                for d in np.unique(matches[:, 0]).tolist():
                    a, b = starts[d], starts[d + 1]
                    own = np.flatnonzero(np.diff(hit[a:b].astype(np.int8), prepend=0, append=0)).tolist()
                    spans[d] = merged([*zip(spans[d][::2], spans[d][1::2], strict=True), *zip(own[::2], own[1::2], strict=True)])
                parts = [item_ids.take(pa.array(matches[:, 2])), *(pa.array(matches[:, k], pa.int32()) for k in (3, 1, 4, 5))]
                lists = _appended(step.column("matches"), matches[:, 0], pa.StructArray.from_arrays(parts, fields=list(_MATCHES.value_type)))
                whole = pa.RecordBatch.from_arrays(
                    [step.column("doc_id"), step.column("text").cast(pa.string()), pa.array(np.diff(starts), pa.int64()), pa.array(spans, pa.list_(pa.int32())), lists, step.column("row")],
                    ["doc_id", "text", "n_words", "spans", "matches", "row"],
                )
                ends, at = np.cumsum(np.asarray(lists.value_lengths())), 0
                while at < whole.num_rows:
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                    yield whole.slice(at, stop - at)
                    at = stop

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """Items in blocks of about `limit` bytes of text."""
    block, held = [], 0
    for r in benchmark.select(F.col(item).cast("string"), text, F.octet_length(text)).toLocalIterator():
        block.append((r[0], r[1]))
        held += r[2] or 0
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, item_ids (array), matches (for each item its longest
    verbatim one, the first of equal ones, with its location, and at how many places windows of the item stand), contaminated.

    A window is `window` consecutive words of an item, or a shorter item as a whole; words inside any occurrence are hit.
    Null texts have no words; items without words match nothing. An item with a null item_id hits words like any other and
    has matches, but no place among item_ids; items that share an item_id count there as one. Repeated rows and doc_ids of
    docs are rows of their own, other columns don't matter. Nothing is shuffled: each Arrow step of a task is a shard with a suffix array of its own, and the
    benchmark goes out in blocks of block_bytes, each a pass over the documents. keep: also return all columns of docs
    (in a struct named row).
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(None).cast("int")
    out = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"), row.alias("row"))
    out = out.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<struct<item_id:string,item_word:int,doc_word:int,n_words:int,n_places:int>>").alias("matches"), "row")
    schema = out.schema
    blocks = 0
    for block in _blocks(benchmark, item, item_text, block_bytes):
        out = out.mapInArrow(tidy(_search(docs.sparkSession.sparkContext.broadcast(TestSuffixes(block, window)), window)), schema)
        blocks += 1
    if not blocks:
        out = out.mapInArrow(tidy(_search(docs.sparkSession.sparkContext.broadcast(TestSuffixes([], window)), window)), schema)
    pairs = F.expr("transform(sequence(0, size(spans) - 1, 2), i -> spans[i + 1] - spans[i])")
    hit = F.when(F.size("spans") > 0, F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
    items = F.array_sort(F.array_compact(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))))
    out = out.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("item_ids"), "matches", "row").withColumn("contaminated", F.col("n_hit") > 0)
    return out if keep else out.drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    return find_contamination(docs, benchmark, keep=True, **options).filter("not contaminated").select("row.*")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, and the longest match of each document: how many words, of which item, and where in both."""
    out = find_contamination(docs, benchmark)
    longest = F.array_max(F.transform("matches", lambda m: F.struct(m["n_words"], (-m["doc_word"]).alias("d"), (-m["item_word"]).alias("w"), m["item_id"])))
    return out.withColumn("longest", longest).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
        F.coalesce("longest.n_words", F.lit(0)).alias("longest_words"), F.col("longest.item_id").alias("longest_item"), (-F.col("longest.d")).alias("longest_at"), (-F.col("longest.w")).alias("longest_item_at"),
    )


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()

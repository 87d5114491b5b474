"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import steps, text_of, tidy
from leadloom.llm.decontaminate import words

#: Labelled rows that a model is fitted on at most, and the part of ids (crc32 modulo FOLDS is 0) that is never among them.
SAMPLE_ROWS, FOLDS = 16_000, 5
#: Bins of the hash, and the bins with most to tell that become terms of the model.
BINS, TERMS = 1 << 22, 4096
#: Length of the latent vectors, passes over the sample, rows of a step, step size, shrinkage.
FACTORS, EPOCHS, ROWS, RATE, SHRINK = 8, 25, 256, 0.15, 2e-5
#: Distinct words whose terms a worker remembers.
REMEMBERED = 400_000


def bins(word: bytes) -> tuple[int, ...]:
    """The word's own bin and those of its first 4 and 5 bytes."""
    own = zlib.crc32(word) % BINS
    if len(word) <= 4:
        return (own,)
    return (own, zlib.crc32(b"4" + word[:4]) % BINS, zlib.crc32(b"5" + word[:5]) % BINS) if len(word) > 5 else (own, zlib.crc32(b"4" + word[:4]) % BINS)


def held_out(key: Column) -> Column:
    """True for ids that no label is learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


class Terms(dict):
    """word -> its terms, kept up to REMEMBERED words."""

    def __init__(self, chosen: np.ndarray):
        super().__init__()
        self.number = {int(b): i for i, b in enumerate(chosen)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(self.number[b] for b in bins(word) if b in self.number)
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        return np.array(sorted({t for found in map(self.__getitem__, set(words(text))) for t in found}), np.int64)


class FactorizationMachine:
    """bias + sum of w over a document's terms + dot products of the latent vectors of all pairs of them.

    A document's terms count once each. The pair sum is half of (|sum of v|^2 - sum of |v|^2).
    """

    def __init__(self, terms: int, factors: int = FACTORS, seed: int = 5):
        self.bias = 0.0
        self.w = np.zeros(terms)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (terms, factors))

    def raw(self, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums for the documents whose terms are index[bounds[i]:bounds[i + 1]], and the sums of their vectors."""
        n, row = len(bounds) - 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        v = self.v[index]
        sums = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], 1) if len(index) else np.zeros((n, self.v.shape[1]))
        pairs = 0.5 * ((sums**2).sum(1) - np.bincount(row, (v**2).sum(1), n))
        return self.bias + np.bincount(row, self.w[index], n) + pairs, sums

    def predict(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, bounds)[0], -30, 30)))

    def fit(self, index: np.ndarray, bounds: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> FactorizationMachine:
        """Logistic loss, AdaGrad steps over shuffled rows."""
        rng, terms = np.random.default_rng(seed), len(self.w)
        self.bias = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        gb, gw, gv = 1e-6, np.full(terms, 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for k in range(0, len(order), ROWS):
                rows = order[k : k + ROWS]
                lengths = bounds[rows + 1] - bounds[rows]
                own = np.concatenate([[0], np.cumsum(lengths)])
                take = np.repeat(bounds[rows] - own[:-1], lengths) + np.arange(own[-1])
                ids = index[take]
                raw, sums = self.raw(ids, own)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]
                each = np.repeat(error, lengths)
                used, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, each, len(used)) / len(rows) + SHRINK * self.w[used]
                slope = each[:, None] * (np.repeat(sums, lengths, 0) - self.v[ids])
                dv = np.stack([np.bincount(back, slope[:, f], len(used)) for f in range(slope.shape[1])], 1) / len(rows) + SHRINK * self.v[used] if len(used) else np.zeros((0, self.v.shape[1]))
                db = error.mean()
                gb += db**2
                gw[used] += dw**2
                gv[used] += dv**2
                self.bias -= RATE * db / np.sqrt(gb)
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
        return self


def choose(parts: list[np.ndarray], label: np.ndarray, most: int = TERMS, least_rows: int = 4) -> np.ndarray:
    """The bins whose presence tells most about the label, in order of number: those whose G statistic stands out from that many tests.

    parts: each row's distinct bins. Counts by bin are all that is held besides.
    """
    n, n1 = np.zeros(BINS), np.zeros(BINS)
    for own, y in zip(parts, label, strict=True):
        n[own] += 1
        if y:
            n1[own] += 1
    found = np.flatnonzero(n >= least_rows)
    tests, p, total, ones = int((n > 0).sum()), label.mean(), len(label), label.sum()
    n, n1 = n[found], n1[found]
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda a, b: np.where(a > 0, a * np.log(a / b), 0)
        g = part(n1, n * p) + part(n - n1, n * (1 - p)) + part(ones - n1, (total - n) * p) + part(total - n - ones + n1, (total - n) * (1 - p))
    keep = np.argsort(-g, kind="stable")[:most]
    return np.sort(found[keep[g[keep] > np.log(max(2, tests))]])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS):
    """(terms' bins, machine) from at most sample_rows labelled rows outside the held-out part, the first by a hash of the id.

    Labels other than 0 and 1 aren't used; an id with both counts as toxic. Of rows of docs that repeat an id one is learned
    from, the one with the least bins. Ids are whole numbers. Without any usable row the machine scores everything 0.5 or, with one class
    only, by that class's share.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
    sample = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                found = [np.unique(np.array([b for w in set(words(t)) for b in bins(w)], np.int32)).tobytes() for t in step.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([step.column("doc_id").cast(pa.int64()), step.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "bins"])

    once = rows.mapInArrow(tidy(featurise), "doc_id long, label int, bins binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("bins").alias("bins"))
    table = once.toArrow().sort_by("doc_id")
    y = table.column("label").to_numpy().astype(float)
    parts = [np.frombuffer(b.as_buffer(), np.int32) for b in table.column("bins")]
    if not len(y) or y.min() == y.max():
        machine = FactorizationMachine(0)
        machine.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return np.zeros(0, np.int64), machine
    chosen = choose(parts, y)
    number = np.full(BINS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    known = [t[t >= 0] for t in (number[p] for p in parts)]
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in known])]).astype(np.int64)
    return chosen, FactorizationMachine(len(chosen)).fit(np.concatenate(known).astype(np.int64), bounds, y)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; keep: also all columns of docs, in a struct named row.

    score in 0 to 1 is the machine's probability of label 1 from the whole text alone; predicted is 1 from 0.5 on. Null
    texts count as empty and get the score of a document without terms. Repeated rows and doc_ids get equal scores for
    equal texts; a null doc_id is held out. An empty table gives an empty one, missing labels a constant score.
    """
    chosen, machine = fit(docs, labels, key, text, **options)
    model = docs.sparkSession.sparkContext.broadcast((chosen, machine))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(None).cast("int")
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), text_of(text).alias("text"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, machine = model.value
        terms = Terms(chosen)
        for batch in batches:
            for step in steps(batch):
                parts = [terms.of(t) for t in step.column("text").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [step.column("doc_id"), step.column("held_out"), pa.array(machine.predict(np.concatenate(parts), bounds)), step.column("row")],
                    ["doc_id", "held_out", "score", "row"],
                )

    kind = dict(rows.dtypes)
    out = rows.mapInArrow(tidy(run), rows.schema["doc_id"].dataType.simpleString().join(["doc_id ", f", held_out boolean, score double, row {kind['row']}"]))
    out = out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return out.select("doc_id", "held_out", "score", "predicted", *(["row"] if keep else []))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows predicted toxic. A score of just 0.5 decides nothing (without labels all have it): such rows stay."""
    return score(docs, labels, keep=True, **options).filter("score <= 0.5").select("row.*")

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import fingerprints as fp
from leadloom.llm import queries


def word_hash(text, seed=42):
    return xxhash.xxh64(text.encode(), seed=seed).intdigest()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain(text):
    """(place, hash) of the closed syncmers, one k-mer after the other."""
    letters = re.findall(fp.LETTER, text)
    k, s = fp.LETTERS_K, fp.LETTERS_S
    inner = [signed(word_hash(b, word_hash(a))) for a, b in zip(letters, letters[1:], strict=False)]
    assert s == 2
    out = []
    for i in range(len(letters) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            h = 42
            for x in (window[0], window[2], window[3]):
                h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
            out.append((i, h & fp.MASK))
    if not out and letters:
        out = [(0, word_hash(" ".join(letters)) & fp.MASK)]
    return out


def text_of(found):
    return " ".join(f"{h:08X}{i:X}" for i, h in found)


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """rows of (doc_id, text); every row of the report against plain Python."""
    src = sorted(((i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i, t or "") for i, t in rows), reverse=True)
    want = []
    for n, (_, _, _, i, t) in enumerate(src):
        nxt = src[(n + 1) % len(src)][4]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b = plain(t), plain(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), round(jaccard(a, b), 9), round(jaccard(a, plain(nxt)), 9)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)


def test_every_row(docs, small):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(None, None), (None, "a b"), (3, "again and again " * 9), (3, "again and again " * 9), (-7, "é"), (900, ""), (901, " \n "), (902, "9" * 100_000), (903, "𝔘ni code " * 700)]
    check(rows, fp.edit_report(docs(rows)).collect())


@pytest.mark.parametrize("ids", [[5], [None], [None, None], [0, 1 << 62, -(1 << 62)], [7] * 40 + [8]])
def test_few_ids(docs, ids):
    rows = [(i, f"text {n} of some words that go on" * (n % 4)) for n, i in enumerate(ids)]
    check(rows, fp.edit_report(docs(rows)).collect())


def test_many_buckets(docs, monkeypatch):
    """Ids in clusters, with a hot one, over many small buckets: every row still meets its next."""
    monkeypatch.setattr(fp, "BUCKET_ROWS", 1)
    monkeypatch.setattr(fp, "CELLS", 8)
    rng = random.Random(3)
    ids = [rng.randrange(100) for _ in range(60)] + [10**12 + rng.randrange(9) for _ in range(20)] + [42] * 60 + [None] * 9
    rows = [(i, " ".join(rng.choices(["red", "green", "blue", "gold"], k=rng.randrange(12)))) for i in ids]
    check(rows, fp.edit_report(docs(rows)).collect())


def test_empty(docs):
    assert fp.edit_report(docs([])).count() == 0 == fp.fingerprints(docs([])).count()


def test_equal_texts_and_clashing_names(spark, docs):
    out = fp.fingerprints(docs(["one two three four five six seven", "one two three four five six seven", None]).withColumn("fingerprint", F.lit(1))).collect()
    prints = {r.text: r.fingerprint for r in out}
    assert len({r.fingerprint for r in out if r.text}) == 1 and prints[None] == ""


def test_shared_passages_have_shared_anchors(spark):
    """Context-free: a passage keeps its anchors, in order, between other words and at any place."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, a, b = words(400), words(300), words(150)
    sides = [f"{a} {passage} {a}", f"{b} {passage}", f"{a} {words(40)} {passage} {a}"]
    found = [[h for _, h in plain(t)] for t in [passage, *sides]]
    for f in found[1:]:
        assert [h for h in f if h in set(found[0])] == found[0]
    df = spark.createDataFrame([(sides[0], sides[1], sides[2], a)], "p string, q string, r string, s string")
    x = lambda c: fp.anchors(F.col(c))
    r = df.select(fp.likeness(x("p"), x("q")).alias("pq"), fp.aligned(x("q"), x("p")).alias("qp"), fp.aligned(x("p"), x("r")).alias("pr"), fp.likeness(x("s"), x("q")).alias("sq"), fp.aligned(x("s"), x("q")).alias("away")).first()
    assert 0.3 < r.pq < 0.5 and 0.65 < r.qp < 0.8 and r.pr > 0.98 and r.sq == 0 == r.away


def test_closeness_on_the_given_texts(spark):
    got = queries.op13_fingerprints(spark, "/root/testdata/sf0.01").collect()
    long = [r for r in got if r.n_chars > 400]
    assert len(got) == 1000 and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next, r.aligned_edited, r.aligned_next))
    assert sum(r.near_edited > r.near_next for r in long) > 0.98 * len(long)


def test_no_python(docs):
    plan = fp.edit_report(docs(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import re

import pytest

from leadloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(rows, items, window=10):
    places = {}
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if w else ():
            places.setdefault(tuple(w[j : j + n]), set()).add(str(k))
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in places}:
            for p in range(len(w) - n + 1):
                if k := places.get(tuple(w[p : p + n])):
                    found |= k
                    hit |= {*range(p, p + n)}
        out[i] = (len(w), len(hit), len(found), dc.digest(list(found)), bool(hit))
    return out


def found(df, benchmark, **options):
    out = dc.find_contamination(df, benchmark, **options)
    return {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), dc.digest(r.item_ids), r.contaminated) for r in out.collect()}


LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, LINE), (2, "Short ITEM"), (3, None), (4, " ... "), (10, LINE.upper() + " nu"), (5, "a b a b a b a b a b a b")]


@pytest.mark.parametrize("block", [64 << 20, 1])
def test_cases(spark, docs, block):
    texts = [LINE, f"x {LINE} y", LINE.replace("delta", "other"), "a short-item here", None, "", "…", "a b " * 30, "é " + LINE[:40], f"{LINE} {LINE}", "word " * 100_000 + LINE]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found(docs(texts), items, block_bytes=block) == brute([*enumerate(texts)], ITEMS)


def test_matches_and_removal(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs([f"so {LINE} end", "clean text"])
    m = {(x.item_id, x.item_word, x.doc_word, x.n_words) for x in dc.find_contamination(df, items).filter("contaminated").first().matches}
    assert ("1", 0, 1, 12) in m and ("10", 0, 1, 12) in m
    kept = dc.decontaminate(df, items)
    assert kept.columns == df.columns and [r.text for r in kept.collect()] == ["clean text"]
    assert dc.decontaminate(df, items.limit(0)).count() == 2 and dc.decontaminate(docs([]), items).count() == 0


def test_suffix_array_finds_the_longest_match():
    import numpy as np

    s = dc.TestSuffixes([("i", LINE)], 3)
    ids = np.array([s.vocabulary.get(w, 0) for w in dc.words(f"x {LINE} y alpha beta gamma")])
    got = [*dc.shard_matches(ids, np.array([0, len(ids)]), s)]
    assert (0, 1, 0, 0, 12) in got and (0, 14, 0, 0, 3) in got


def test_small_table(spark, small):
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert found(small, b) == brute([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in b.collect()])

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from leadloom.llm import toxicity

GROUPS, INSULTS = ["martians", "robots", "pirates"], ["fools", "liars", "pests"]


def labelled(n=1500):
    """Toxic only when a group and an insult meet: neither tells anything alone."""
    rng, rows = random.Random(8), []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(20)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(GROUPS)] * a + [rng.choice(INSULTS)] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    return rows


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (3000, 2))
    y = (x[:, 0] ^ x[:, 1]).astype(float)
    index = np.concatenate([np.flatnonzero(r) for r in x]).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(x.sum(1))]).astype(np.int64)
    p = toxicity.FactorizationMachine(2, factors=4).fit(index, bounds, y, epochs=60).predict(index, bounds)
    assert ((p >= 0.5) == y).mean() > 0.95  # a linear model can't exceed 0.75


def test_scores(spark, docs):
    rows = labelled()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (10**6, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    df = docs([(i, t) for i, t, _ in rows] + [(90_000, None), (90_001, ""), (None, "martians fools"), (90_002, "martians " * 50_000)])
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and got[90_000].score == got[90_001].score
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got.values())


def test_labels_outside_the_fold_only(spark, docs):
    rows = labelled(400)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    df = docs([(i, t) for i, t, _ in rows])
    frames = [spark.createDataFrame([(i, flip ^ y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int") for flip in (0, 1)]
    a, b = ({r.doc_id: r.score for r in toxicity.score(df, f).collect()} for f in frames)
    assert a == b


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs(["a", None]), none).collect()} == {0.5}
    assert toxicity.score(docs([]), none).count() == 0


def copies(doc_id, sources, seed=17):
    """How often a document repeats: the first count whose summed probability is above the hashed number. Weights are roots of the sources' sizes."""
    n = Counter(sources.values())
    rate = math.sqrt(n[sources[doc_id]]) / sum(map(math.sqrt, n.values())) * sum(n.values()) / n[sources[doc_id]]
    u, k, p = (int(hashlib.md5(f"{seed}/{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, 0, math.exp(-rate)
    below = p
    while below <= u:
        k += 1
        p *= rate / k
        below += p
    return k


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(None, "null id", "en", "a", 7), (None, "null id", "en", "a", 7), (1, None, None, None, None), (1, "", "en", "b", 0), (1, "same id", "en", "b", 7), (2, "x " * 40_000, "en", "a", 80_000)]])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """Empty tables, null ids and texts, repeated rows and ids, and columns more than documents have run through."""
    spark.createDataFrame([(*r, 1, "x") for r in rows], f"{ROWS}, n_copies int, tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (3, "ten words that no document of this small table has at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert sorted(docs.columns) == sorted([*(c.split()[0] for c in ROWS.split(", ")), "n_copies", "tokens"])
        assert k or docs.count() == len(rows)  # without labels nothing is found toxic
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    near = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(["None"] * sum(r[0] is None for r in rows) + ["1", "2"] * (len(rows) > 1))


def test_pipeline(spark):
    """Each stage against plain Python on its own input, and run() against the last."""
    from tests.llm.test_decontaminate import brute as contaminated
    from tests.llm.test_near_stage import kept
    from tests.llm.test_special_tokens import plain
    from tests.llm.test_toxic_labels import plain_score

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    texts = [[(r.doc_id, r.text) for r in d.collect()] for d in out[:-1]]
    assert all(d.columns == docs.columns for d in out[:-1])
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(texts[1]) == sorted(r for r in texts[0] if plain_score(r[1], *model) < 0.5)
    keep = kept(texts[1])
    assert sorted(texts[2]) == sorted(r for r in texts[1] if r[0] in keep)
    bad = contaminated(texts[2], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert sorted(texts[3]) == sorted(r for r in texts[2] if not bad[r[0]][-1])
    sources = {r.doc_id: r.source for r in out[3].collect()}
    assert sorted(texts[4]) == sorted(r for r in texts[3] for _ in range(copies(r[0], sources)))
    assert sorted(tuple(r) for r in out[5].collect()) == sorted(plain(sorted(texts[4])))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in out[5].collect())

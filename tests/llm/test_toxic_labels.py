import zlib

import numpy as np

from leadloom.llm import toxicity
from tests.llm.test_toxicity_and_pipeline import labelled


def plain_score(text, chosen, machine):
    """Bias, weights and every pair's dot product, one by one."""
    from leadloom.llm.decontaminate import words

    number = {int(b): i for i, b in enumerate(chosen)}
    terms = sorted({number[b] for w in words(text or "") for b in toxicity.bins(w) if b in number})
    raw = machine.bias + sum(machine.w[i] for i in terms) + sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(terms) for j in terms[k + 1 :])
    return 1 / (1 + np.exp(-raw))


def test_scores_are_explicit_pair_sums(spark, docs):
    rows = labelled(600)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    df = docs([(i, t) for i, t, _ in rows] + [(90_000, None)])
    chosen, machine = toxicity.fit(df, labels)
    texts = {i: t for i, t, _ in rows} | {90_000: None}
    assert len(chosen) and np.abs(machine.v).max() > 0.01
    for r in toxicity.score(df, labels).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], chosen, machine)) < 1e-9


def test_clashing_labels_and_repeated_rows(spark, docs):
    rows = labelled(500)
    learned = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5][:40]
    once = [(i, y if i not in learned else 1) for i, _, y in rows]
    clash = [(i, y) for i, _, y in rows] + [(i, k) for i in learned for k in (0, 1)]
    df = docs([(i, t) for i, t, _ in rows])
    twice = df.unionByName(df.filter("doc_id % 3 = 0"))
    got = [{r.doc_id: r.score for r in toxicity.score(d, spark.createDataFrame(y, "doc_id long, toxic int").repartition(n)).collect()} for d, y, n in ((df, once, 1), (df, clash, 3), (df, clash[::-1], 2), (twice, clash, 1))]
    assert got[0] == got[1] == got[2] == got[3]

import random
import time

import numpy as np

from leadloom.llm import decontaminate as dc
from tests.llm.test_decontaminate import LINE, brute, found, words


def longest(text, items, window=10):
    """For each item with a window in the text, the length of the longest run of words that both have, by all pairs of places."""
    w, out = words(text), {}
    for item, t in items:
        v = words(t)
        run = np.zeros(len(v) + 1, int)
        best = 0
        for x in w:
            run[1:] = [run[j] + 1 if v[j] == x else 0 for j in range(len(v))]
            best = max(best, run.max())
        if v and best >= min(window, len(v)):
            out[str(item)] = best
    return out


def test_random_texts_of_few_words(spark, docs):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(1, 40))) for i in range(12)]
    texts = [text(rng.randint(0, 300)) for _ in range(30)] + ["a " * 200, "x " + items[3][1] + " y"]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(docs(texts), table) == brute([*enumerate(texts)], items)
    for r in dc.find_contamination(docs(texts), table).collect():
        got = {}
        for m in r.matches:
            w, v = words(texts[r.doc_id]), words(dict(items)[int(m.item_id)])
            assert w[m.doc_word : m.doc_word + m.n_words] == v[m.item_word : m.item_word + m.n_words] and m.n_words > 0
            got[m.item_id] = max(got.get(m.item_id, 0), m.n_words)
        assert got == longest(texts[r.doc_id], items)


def test_repeated_words_stay_linear():
    s = dc.TestSuffixes([("i", "a " * 2_000), ("j", "a b " * 1_000)])
    ids = np.array([s.vocabulary[w] for w in dc.words("a " * 20_000 + "a b " * 10_000)])
    start = time.monotonic()
    hit, matches = dc.search_shard(ids, np.array([0, len(ids)]), s)
    assert time.monotonic() - start < 20 and hit.all() and matches[:, 4].max() == 2_000 and len(matches) <= 2 * len(ids)


def test_items_without_an_id_or_with_a_shared_one(spark, docs):
    items = spark.createDataFrame([(None, LINE), (7, "one two"), (7, "three four"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.contamination_report(docs([f"x {LINE}", "one two three four", "clean", None]), items).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated, got[i].longest_words) for i in range(4)] == [(12, 0, True, 12), (4, 1, True, 2), (0, 0, False, 0), (0, 0, False, 0)]
    assert got[0].items_sha256 == dc.digest([]) and got[1].items_sha256 == dc.digest(["7"]) and (got[0].longest_at, got[0].longest_item_at) == (1, 0)
    assert sorted(r.text or "" for r in dc.decontaminate(docs([LINE, "clean", None]), items).collect()) == ["", "clean"]

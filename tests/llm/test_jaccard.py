import random
import re
from collections import Counter

import pytest

from leadloom.llm import jaccard
from leadloom.llm.components import components


def brute(rows, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    inverted, up = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            inverted.setdefault(g, []).append(i)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j != i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {(i, len(sets[i]), root(i)) for i in sets}


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("percent,blocks", [(90, 512), (80, 4)])
def test_families(docs, monkeypatch, percent, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", blocks)
    rng, rows = random.Random(percent), []
    common = " ".join(f"common{k}" for k in range(40))
    for _ in range(6):
        base = [f"w{rng.random()}" for _ in range(rng.choice([12, 60, 200]))]
        rows += [mutated(rng, base, rng.choice([0, 0, 1, 2, 4])) for _ in range(15)]
        chain = list(base)
        for _ in range(6):
            chain = mutated(rng, chain, 1).split()
            rows.append(" ".join(chain))
    rows += [common + " " + " ".join(f"u{rng.random()}" for _ in range(30)) for _ in range(25)]
    rows += [None, "", " \n", "one", "One", "two words", "three small words", "x" * 100_000, "a b c " * 5_000]
    rng.shuffle(rows)
    got = {tuple(r) for r in jaccard.jaccard_components(docs(rows), percent=percent).collect()}
    assert got == brute([*enumerate(rows)], percent)


def test_odd_tables(docs):
    assert jaccard.jaccard_components(docs([])).count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    got = sorted(jaccard.jaccard_components(docs([(7, text), (7, text), (9, text), (None, "x"), (3, "y")])).collect(), key=str)
    assert [r.component_id for r in got if r.doc_id in (7, 9)] == [7, 7, 7] and len(got) == 5


def test_one_stays(docs):
    text = " ".join(f"w{k}" for k in range(60))
    df = docs([(4, text), (2, text + " tail"), (3, "other text here"), (1, None), (None, text)])
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 3}  # the null id is the smallest and stands for the group


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + k) for k in range(20) if k != 50] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == 50 and len(got) == 61
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_table(small):
    assert {tuple(r) for r in jaccard.jaccard_components(small).collect()} == brute([(r.doc_id, r.text) for r in small.collect()])

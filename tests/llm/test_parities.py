import random

import numpy as np
import pytest

from leadloom.llm import jaccard


def test_parities_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 5, 300, 2000)]
    sets += [np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 64, k, np.uint64)])) for s in sets[1:] for k in (0, 1, 5, 30)]
    odd = jaccard.parities(sets)
    bits = [int.from_bytes(o.tobytes(), "little") for o in odd]
    for a, x in zip(sets, bits, strict=True):
        assert x.bit_count() % 2 == len(a) % 2
        for b, y in zip(sets, bits, strict=True):
            assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))
    assert jaccard.parities([]).shape == (0, jaccard.WORDS)


def rows_met(spark, docs, monkeypatch, n):
    """Texts of common words, of which chance brings pairs together by a rare triple; every twentieth has a near copy."""
    rng, words = random.Random(n), [f"w{k}" for k in range(60)]
    texts = [[rng.choice(words) for _ in range(120)] for _ in range(n)]
    near = [[*t[:60], "other", *t[61:]] for t in texts[::20]]
    sizes, saved = {}, jaccard.saved
    monkeypatch.setattr(jaccard, "saved", lambda df, name: sizes.setdefault(name, saved(df, name)))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs([" ".join(t) for t in texts + near])).collect()}
    monkeypatch.setattr(jaccard, "saved", saved)
    assert all(found[n + k] == 20 * k for k in range(len(near))) and len(set(found.values())) == n
    return sizes["met"].count()


@pytest.mark.parametrize("n", [400, 2000])
def test_pairs_by_chance_make_no_rows(spark, docs, monkeypatch, n):
    assert rows_met(spark, docs, monkeypatch, n) < n

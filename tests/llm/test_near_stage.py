import re

import corpus_pipeline


def kept(rows):
    """Documents that stay, by comparing all pairs of sets of five words at 0.8."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    name = {i: i for i in sets}
    for i, s in sets.items():
        for j, other in sets.items():
            if j < i and s and 100 * len(s & other) >= 80 * len(s | other) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return {i for i, v in name.items() if i == v}


def test_five_words_at_eighty(docs, small, spark):
    words = [f"w{k}" for k in range(100)]
    text = " ".join(words)
    longer = lambda n: text + "".join(f" tail{n}x{k}" for k in range(n))
    changed = " ".join(f"new{k}" if k in (20, 60) else w for k, w in enumerate(words))
    rows = [(1, text), (2, longer(20)), (3, longer(40)), (4, changed), (5, "a b c d"), (6, "A b c d"), (7, "a b c"), (8, None)]
    # sets of four and five tokens at exactly 0.8, and one below it
    rows += [(20, "p q r s t u v w"), (21, "p q r s t u v w x"), (22, "p q r s t u v w x y z")]
    assert kept(rows) == {1, 3, 5, 7, 8, 20, 22}
    found = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()}
    assert found == kept(rows)
    whole = [(r.doc_id, r.text) for r in small.collect()]
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, small, "").collect()} == kept(whole)

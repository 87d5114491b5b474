import time
import tracemalloc

import numpy as np

from leadloom.llm import decontaminate as dc

TEMPLATE = "please answer the following question about the given passage of text with one"


def numbered(suffixes, text):
    return np.array([suffixes.vocabulary.get(w, 0) for w in dc.words(text)])


def test_one_template_in_many_items_and_places():
    """5,000 items with one template against 1,000 occurrences: a row for each item, not for each pair."""
    s = dc.TestSuffixes([(str(i), f"{TEMPLATE} item{i}") for i in range(5000)])
    ids = numbered(s, " ".join(f"{TEMPLATE} word{k}" for k in range(1000)))
    tracemalloc.start()
    start = time.process_time()
    hit, rows = dc.longest_matches(ids, np.array([0, len(ids)]), s)
    took, most = time.process_time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(dc.words(TEMPLATE))
    assert rows.tolist() == [[0, 0, i, 0, n, 1000 * (n - 9)] for i in range(5000)] and hit.sum() == 1000 * n
    assert took < 5 and most < 100 << 20


def test_one_row_for_each_document_and_item():
    """The same longest matches as search_shard gives, whatever the number of pairs at once."""
    rng = np.random.default_rng(3)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3, n))
    items = [(str(i), line(int(rng.integers(1, 12)))) for i in range(12)]
    s = dc.TestSuffixes(items, 4)
    parts = [numbered(s, line(int(rng.integers(0, 40))) + " other " + line(9)) for _ in range(20)]
    ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    hit, every = dc.search_shard(ids, starts, s)
    want = {}
    for d, p, i, _, n in every.tolist():
        want[d, i] = max(want.get((d, i), (0, 0)), (n, -p))
    for limit in (1, 50, 1 << 20):
        own_hit, rows = dc.longest_matches(ids, starts, s, limit)
        assert (own_hit == hit).all() and {(d, i): (n, -p) for d, p, i, _, n, _ in rows.tolist()} == want and len(rows) == len(want)
        for d, p, i, w, n, _ in rows.tolist():
            own = s.text[s.starts[i] : s.starts[i + 1]]
            assert (ids[starts[d] + p : starts[d] + p + n] == own[w : w + n]).all()

import hashlib
import random

import numpy as np
import pytest

from leadloom.llm import repeats


def brute(rows):
    first, out = {}, set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def cases():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    line, long = text(130), text(900)
    rows = [text(300) + line + text(200) for _ in range(12)] + [long, long, long[:400] + "X" + long[401:], "pre " + long, long[250:600], text(99), text(99)]
    rows += [None, "", "a" * 1000, "ab" * 400, text(150) + "a" * 120, "a" * 100, line, line, "q" + line[:99], line[:100] + "q"]
    return [*enumerate(rows)]


@pytest.mark.parametrize("hot", [5_000, 3])
def test_cases(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_PLACES", hot)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 1_000)
    assert {tuple(r) for r in repeats.mark_repeats(docs(cases())).collect()} == brute(cases())


def test_removal(docs):
    df = docs(cases())
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert repeats.remove_repeats(df).columns == df.columns and out[0].text == cases()[0][1] and out[13].text == ""
    assert repeats.mark_repeats(docs([])).count() == 0
    same = [tuple(r)[:3] for r in repeats.mark_repeats(docs([(5, "z" + "abc" * 60), (5, "z" + "abc" * 60), (None, "k" * 30)])).collect()]
    assert len(same) == 3 and same.count((5, 181, 177)) == 2


def test_index_runs():
    text = np.frombuffer((b"banana bandana " * 40), np.uint8)
    starts = np.arange(len(text) - 99)
    index = repeats.RunLengthIndex(text, starts)
    suffix, source = index.sources()
    raw = text.tobytes()
    assert index.sizes.sum() == len(starts) and len(index.heads) < len(starts) // 4
    for s, e in zip(suffix, source, strict=True):
        assert e == raw.find(raw[s : s + 100])


def test_small_table(small):
    assert {tuple(r) for r in repeats.mark_repeats(small).collect()} == brute([(r.doc_id, r.text) for r in small.collect()])

import hashlib
import re

from leadloom.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = set()
    for body, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1] is not None, m[1]))[1]
        out |= {(i, keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest()) for _, i in members}
    return out


def found(df, **options):
    return {tuple(r) for r in exact_dedup.exact_duplicates(df, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}


def test_cases(docs):
    rows = [(5, "a b"), (3, "ab"), (4, " a\tb\n"), (9, None), (8, ""), (7, " \x0b\x0c"), (1, "x" * 200_000), (2, "x" * 200_000 + " "), (6, "é a"), (10, "éa"), (11, "a b"), (None, "null id"), (12, "null id")]
    assert found(docs(rows)) == brute(rows)


def test_many_runs_and_empty(docs, monkeypatch):
    rows = [(i, f"text {i % 17}" + " " * (i % 5)) for i in range(400)]
    monkeypatch.setattr(exact_dedup, "MEMTABLE_BYTES", 2_000)
    df = docs(rows)
    assert {tuple(r) for r in exact_dedup.index(df, memtable_bytes=2_000).groupBy("doc_id").count().filter("count <> 1").collect()} == set()
    assert found(df) == brute(rows)
    assert found(docs([])) == set()


def test_repeated_rows(docs):
    assert sorted(r[2:4] for r in exact_dedup.exact_duplicates(docs([(1, "a"), (1, "a"), (1, "b")])).collect()) == [(1, True), (2, True), (2, True)]


def test_equal_digests_of_different_texts(docs, monkeypatch):
    """Bytes decide, not digests: the settling by text gives whole groups."""
    df = docs([(1, "a"), (2, "a "), (3, "b"), (4, "c")])
    digests = df.sparkSession.createDataFrame([(bytearray(hashlib.sha256(b"a").digest()),)], "digest binary")
    got = {tuple(r)[:4] for r in exact_dedup._by_text(df, digests, "doc_id", "text").collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True)}


def test_small_table(small):
    assert found(small) == brute([(r.doc_id, r.text) for r in small.collect()])

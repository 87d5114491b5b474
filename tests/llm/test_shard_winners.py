import hashlib
import struct
import zlib

import xxhash

from leadloom.llm import secrets, sharding


def winner(key, shards):
    """The shard with the largest draw; of equal ones the lower."""
    draws = [int(hashlib.md5(f"{'null' if key is None else key}/{k}".encode()).hexdigest()[:13], 16) for k in range(shards)]
    return draws.index(max(draws))


def test_every_winner_and_slot(docs, small):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(None, None), (None, ""), (3, "again"), (3, "again"), (-7, "é")]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in sharding.placement(docs(rows)).collect()]
    block = lambda i: (42 if i is None else xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()) % sharding.BLOCKS
    want, slots = [], {}
    order = lambda r: (winner(r[0], 16), block(r[0]), r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    for i, t in sorted(rows, key=order):
        body, s = (t or "").encode(), winner(i, 16)
        slots[s] = slots.get(s, -1) + 1
        want.append((i, len(body) + 1, zlib.crc32(body), s, slots[s], winner(i, 17)))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_secrets_of_repeated_rows(docs):
    key = "Zx81Qm4Tn7Vb2Lk9Wc5Jh3Ry6Pd0"
    got = secrets.find_secrets(docs([(1, f"Bearer {key}"), (1, f"Bearer {key}"), (None, f"token={key}"), (1, "other")])).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", ""), ("1", "novel:7:35"), ("1", "novel:7:35"), ("None", "assign:0:34")]

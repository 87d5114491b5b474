import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import context_coder, mixing, sharding, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_coder():
    rng = np.random.default_rng(1)
    skewed = (rng.zipf(1.3, 5000) % 50_000).astype(np.uint16)
    blocks = [skewed[:2048], skewed[2048:4000], np.zeros(2048, np.uint16), np.tile(skewed[:50], 40), rng.integers(0, 65536, 700).astype(np.uint16), np.full(1500, 65535, np.uint16), skewed[:1], skewed[:0]]
    coded = context_coder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, context_coder.decode(coded, [len(b) for b in blocks]), strict=True))
    assert context_coder.decode([coded[1]], [len(blocks[1])])[0].tolist() == blocks[1].tolist()  # a block alone
    assert len(coded[2]) < 200 and len(coded[3]) < 1200 and len(coded[0]) < 2 * 2048 * 0.8


def test_units():
    ids = np.arange(5000, dtype=np.uint16) % 700
    unit = token_output.pack([3, None, 3], np.array([10, 0, 4990]), ids)
    got = token_output.unpack(unit)
    assert got[0] == [3, None, 3] and got[1].tolist() == [10, 0, 4990] and (got[2] == ids).all()
    for at in (20, len(unit) - 30):
        with pytest.raises(ValueError):
            token_output.unpack(unit[:at] + bytes([unit[at] ^ 1]) + unit[at + 1 :])


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    at, out = 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


TEXTS = ["Hello world's end", None, "", "two  blanks", " lead", "trail ", "tab\there", "new\nline here", "a b c", "é ü 漢字 text", "<|endoftext|> x", "word " * 20_000, "12 345 !? ...", "x" * 5_000]


def test_token_round_trip(docs, spark, tmp_path):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)]
    got = sorted(tuple(r) for r in token_output.round_trip(docs(rows)).collect())
    assert got == sorted(expected(sorted(rows)))
    assert token_output.round_trip(docs([])).count() == 0
    assert Counter(r.n_tokens for r in token_output.round_trip(docs([(1, "a"), (1, "a"), (None, "a")])).collect()) == {2: 3}
    token_output.write_tokens(docs(rows), str(tmp_path / "t"), PATH, unit_ids=1000)  # several units in a task
    back = token_output.read_tokens(spark, str(tmp_path / "t"), with_ids=True)
    assert sorted(tuple(r)[:4] for r in back.collect()) == got and back.filter("size(ids) <> n_tokens").count() == 0


def test_pieces_equal_whole_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "The", " ", "'s", "\n", ".", "é", "1", "!", "don't", "_", "ñandú", "ß.", "x,", "ſo", "Ā", "漢", "¡a!"]) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    ids, sizes = token_output.Tokens(PATH).of(texts)
    assert sizes.tolist() == [n for _, _, n, _ in expected([*enumerate(texts)])]
    ends = np.cumsum(sizes)
    assert [zlib.crc32(ids[b - n : b].astype("<u4").tobytes()) for b, n in zip(ends, sizes, strict=True)] == [c for *_, c in expected([*enumerate(texts)])]


def test_sharding(docs, small):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(None, None), (None, ""), (3, "again")]
    got = sharding.placement(docs(rows)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got) and any(r.grown_shard == 16 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and sharding.placement(docs([])).count() == 0


def test_weights(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    n = Counter(r[0] for r in keys.select(sharding.rendezvous(F.col("k"), [1.0, 3.0, 0.0])).collect())
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("k"), [0.0])


def test_mixing(spark, docs):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 6 == 0, "a").when(F.col("id") % 6 < 5, "b").alias("source"), F.lit(1).alias("copy_no"))
    out = mixing.mix(rows, {"a": 0.5, "b": 0.25, "": 0.25})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] / 3000 - 1) < 0.06 and abs(n["b"] / 1500 - 1) < 0.08 and abs(n[None] / 1500 - 1) < 0.08
    assert out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.max("copy_no").alias("c")).filter("n <> m or c <> n - 1").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(rows.repartition(5), {"a": 0.5, "b": 0.25, "": 0.25}).collect()))
    assert mixing.mix(docs([])).count() == 0 and mixing.mix(rows, {"a": 1.0}).filter("source <> 'a' or source is null").count() == 0
    assert mixing.mix(docs([(None, None), (None, "x")]), size=3.0).columns[: len(docs([]).columns)] == docs([]).columns


def test_poisson_cdf(spark):
    import math

    for rate in (0.0, 0.3, 4.0, 900.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first().c
        assert cdf == sorted(cdf) and abs(cdf[-1] - 1) < 1e-9
        k = min(int(rate), len(cdf) - 1)
        assert abs(cdf[k] - sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1)) if rate else cdf[0] - 1) < 1e-9


def test_native_plans(docs):
    for df in (sharding.placement(docs(["a"])), mixing.mix(docs(["a"]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan

import math
import time

from pyspark.sql import functions as F

from leadloom.llm import mixing


def test_tables_of_large_rates(spark):
    start = time.monotonic()
    for rate in (150.0, 400.0, 4_000.0, 1e6):
        r = spark.range(1).select(mixing.lowest(F.lit(rate)).alias("k"), mixing.poisson_cdf(F.lit(rate), mixing.lowest(F.lit(rate))).alias("c")).first()
        p = lambda k: math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))  # noqa: B023, E731
        assert len(r.c) <= 24 * math.sqrt(rate) + 70 and r.c == sorted(r.c) and abs(r.c[-1] - 1) < 1e-7
        half = int(rate) - r.k
        assert abs(r.c[half] - math.fsum(p(k) for k in range(r.k, int(rate) + 1))) < 1e-7
        if rate < 5_000:
            whole = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first().c
            assert max(abs(a - b) for a, b in zip(whole[r.k :], r.c, strict=True)) < 1e-9
    assert time.monotonic() - start < 60


def test_a_rare_source_of_large_rate(spark, monkeypatch):
    docs = spark.range(40_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(docs, {"rare": 1.0, "s0": 1.0, "s1": 1.0}).groupBy("source").count().collect()}
    assert set(n) == {"rare", "s0", "s1"} and all(abs(v / (40_001 / 3) - 1) < 0.05 for v in n.values())
    one = sorted(map(tuple, mixing.mix(docs.limit(500)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, mixing.mix(docs.limit(500)).collect())) == one

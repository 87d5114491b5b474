"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import saved

#: Numbers in all sources' tables up to which these are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_NUMBERS = 4_000_000
#: Share of all rows from which a source is hot, and the parts that a shuffle deals it to.
HOT_SHARE, PARTS = 0.01, 64
#: Half the width of a rate's table, in deviations (and SPARE counts more): what is beyond has less than 1e-30 of the distribution.
DEVIATIONS, SPARE = 12, 30


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts decide."""
    digest = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def lowest(rate: Column) -> Column:
    """The first count whose probability matters."""
    return F.greatest(F.lit(0), F.floor(rate - DEVIATIONS * F.sqrt(rate) - SPARE)).cast("long")


def _log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, for n of 20 or more."""
    return n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)


def poisson_cdf(rate: Column, first: Column | None = None) -> Column:
    """P(count <= k) for k = first, first + 1, ... up to far beyond the rate, summed from logarithms, so that no rate underflows.

    first is 0 or a count below which the distribution has nothing that matters, as from lowest(): the table then grows
    with the root of the rate only.
    """
    first = F.lit(0).cast("long") if first is None else first
    last = F.ceil(rate + DEVIATIONS * F.sqrt(rate) + SPARE).cast("long")
    at = first.cast("double")
    start = F.when(first < 20, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), first)), -rate, lambda x, k: F.when(k <= first, x + F.log(rate) - F.log(k.cast("double"))).otherwise(x))).otherwise(
        at * F.log(rate) - rate - _log_factorial(at)
    )
    zero = F.struct(start.alias("log"), F.exp(start).alias("sum"), F.array(F.exp(start)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(first + 1, last), zero, step)["cdf"]).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, targets: dict[str, float] | None, size: float, source: str = "source", power: float = 0.5) -> DataFrame:
    """One row for each source: rows, share wanted, mean repetitions and their distribution. Without targets the shares follow rows ** power.

    Counts are of all rows, added up before the shuffle. size: rows wanted in all, as a multiple of the rows there are.
    A null source is a source of its own, named '' in targets. Sources that targets don't name get no copies.
    """
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    counts = docs.groupBy(name.alias("_mix_source")).agg(F.count("*").alias("_mix_rows"))
    if targets is None:
        wanted = F.pow(F.col("_mix_rows").cast("double"), F.lit(float(power)))
    else:
        wanted = F.lit(0.0)
        for key, weight in targets.items():
            wanted = F.when(F.col("_mix_source") == key, F.lit(float(weight))).otherwise(wanted)
    counts = counts.withColumn("_mix_weight", wanted)
    total = counts.agg(F.sum("_mix_weight").alias("_mix_weights"), F.sum("_mix_rows").alias("_mix_all"))
    rate = F.coalesce(F.col("_mix_weight") / F.col("_mix_weights") * F.col("_mix_all") * F.lit(float(size)) / F.col("_mix_rows"), F.lit(0.0))
    found = counts.crossJoin(F.broadcast(total)).select("_mix_source", (F.col("_mix_rows") / F.col("_mix_all")).alias("_mix_share"), rate.alias("_mix_rate")).withColumn("_mix_first", lowest(F.col("_mix_rate")))
    return found.withColumn("_mix_cdf", poisson_cdf(F.col("_mix_rate"), F.col("_mix_first")))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, size: float = 1.0, seed: int = 17, key: str = "doc_id", source: str = "source", power: float = 0.5) -> DataFrame:
    """docs, each row as often as a Poisson draw says, shuffled globally; adds copy_no (from 0), n_copies and mix_key.

    The draw inverts the distribution whose mean is the source's rate, at a uniform number hashed from seed and key, so
    it is the same on any machine and in any order. Rows with equal keys get equal draws; a null key is a key of its
    own. Rows are dealt out by a hash of (key, copy), the mix_key, and ordered by it in each partition: no source or
    copied row makes a partition large. Columns of docs named like the added ones are replaced. Empty tables give empty
    tables. The sources' tables, whose length grows with the root of a rate, are worked out once and broadcast while they
    have BROADCAST_NUMBERS in all (counted); else they are joined by shuffle, hot sources in PARTS.
    """
    table = saved(rates(docs, targets, size, source, power), "rates")
    few = (table.agg(F.sum(F.size("_mix_cdf"))).first()[0] or 0) <= BROADCAST_NUMBERS
    rows = docs.drop("copy_no", "n_copies", "mix_key").withColumn("_mix_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    if few:
        rows = rows.join(F.broadcast(table), "_mix_source")
    else:
        hot = F.col("_mix_source").isin([r[0] for r in table.filter(F.col("_mix_share") >= HOT_SHARE).select("_mix_source").collect()])
        parts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
        mine = F.when(hot, F.pmod(F.xxhash64(key, F.lit(1)), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
        rows = rows.withColumn("_mix_part", mine).join(table.withColumn("_mix_part", parts), ["_mix_source", "_mix_part"]).drop("_mix_part")
    drawn = (
        rows.withColumn("_mix_u", uniform(F.lit(seed), F.col(key)))
        .withColumn("n_copies", (F.col("_mix_first") + F.size(F.filter("_mix_cdf", lambda c: c <= F.col("_mix_u")))).cast("int"))
        .filter("n_copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("mix_key", F.md5(F.concat_ws("/", F.lit(seed).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy_no").cast("string"))))
        .drop("_mix_source", "_mix_share", "_mix_rate", "_mix_first", "_mix_cdf", "_mix_u")
    )
    return drawn.repartition("mix_key").sortWithinPartitions("mix_key")

"""Joins with lists and earlier results, and first-row deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.urls import label_suffixes
from leadloom.shared import shared_path

#: Entries of a list up to which it is a literal in the plan, or broadcast; longer ones are joined by shuffle.
LITERAL_LIST, BROADCAST_LIST = 1_000, 100_000
#: Bloom filters: bits in a block (what Spark's bitmap functions make), hashes of a key, and blocks at most.
BLOCK_BITS, FILTER_HASHES, FILTER_BLOCKS = 32_768, 5, 16_384


def list_table(df: DataFrame, words: list[str], name: str) -> DataFrame:
    """A list as a one-column table, with a broadcast hint while it is short."""
    table = df.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], f"{name} string")
    return F.broadcast(table) if len(words) <= BROADCAST_LIST else table


def drop_listed(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose value is in the list go; null values stay."""
    if len(words) <= LITERAL_LIST:
        return df.filter(F.col(column).isNull() | ~F.col(column).isin(words)) if words else df
    return df.join(list_table(df, words, column), column, "left_anti")


def drop_suffixes(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose domain is in the list, or below one in it, go: an equality on parent domains, never a comparison of all pairs."""
    if not words:
        return df
    if len(words) <= LITERAL_LIST:
        return df.filter(F.col(column).isNull() | ~F.arrays_overlap(label_suffixes(F.col(column)), F.array(*map(F.lit, words))))
    parents = df.select(column).distinct().withColumn("_parent", F.explode(label_suffixes(F.col(column))))
    hit = parents.join(list_table(df, words, "_parent"), "_parent", "left_semi").select(column).distinct()
    return df.join(hit, column, "left_anti")


def without(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among those done."""
    return df.join(done.select(*keys), keys, "left_anti")


def seen_filter(seen: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """A Bloom filter of seen keys as a table: block, bits. A key has FILTER_HASHES bits in one block of 32,768, some 12 bits for each key.

    n: how many keys, counted if not given. There are at most FILTER_BLOCKS blocks (64 MB); with more keys than they hold
    well, more rows count as perhaps seen.
    """
    n = seen.count() if n is None else n
    blocks = min(FILTER_BLOCKS, max(1, -(-n * 12 // BLOCK_BITS)))
    bit = F.explode(F.array(*[_bit(F.col(key), k) for k in range(FILTER_HASHES)]))
    return seen.filter(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("blocks", F.lit(blocks))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _bit(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK_BITS))


def without_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those seen. Those that a Bloom filter surely doesn't hold pass without a shuffle.

    Only the others, few where most keys are new, are joined with the seen keys. The filter is broadcast, at most 64 MB. df is
    read twice, once for each kind of row, so this pays where shuffling it costs more than reading it; where df is
    shuffled by the key anyway, `without` comes with that shuffle. Rows with a null key stay.
    """
    filter_ = seen_filter(seen, key)
    path = shared_path(df.sparkSession, "seen")
    filter_.write.parquet(path)
    table = df.sparkSession.read.schema(filter_.schema).parquet(path)
    blocks = (table.select("blocks").first() or [1])[0]
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = reduce(lambda a, b: a & b, [F.getbit(byte(_bit(F.col(key), k)), (_bit(F.col(key), k) % 8).cast("int")) == 1 for k in range(FILTER_HASHES)])
    marked = df.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(table.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block", "left")
    maybe = F.col(key).isNotNull() & F.col("_bits").isNotNull() & F.coalesce(held, F.lit(False))
    sure = marked.filter(~maybe).select(*df.columns)
    return sure.unionByName(without(marked.filter(maybe).select(*df.columns), seen, [key]))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; most others go before the shuffle."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_row = 1").drop("_row")


def merge_later_wins(earlier: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """All keys of both; each column from the later table where it has a value."""
    names = [c for c in earlier.columns if c != key] + [c for c in later.columns if c != key and c not in earlier.columns]
    a, b = earlier.alias("a"), later.alias("b")
    pick = [F.coalesce(*[F.col(f"{t}.{c}") for t, df in (("b", later), ("a", earlier)) if c in df.columns]).alias(c) for c in names]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *pick)


def engine_rank(engine: Column, engines: list[str]) -> Column:
    """The place of an engine in the list, from 1; one that isn't there comes after all others."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, engines)), engine).cast("int"), F.lit(0)), F.lit(len(engines) + 1))


def cap_pages(results: DataFrame, pages: int, caps: dict[str, int]) -> DataFrame:
    """Results of the pages asked for, and of no page beyond the last that their engine shows; engines without a cap show all."""
    most = F.lit(pages)
    for engine, cap in caps.items():
        most = F.when(F.col("engine") == engine, min(pages, cap)).otherwise(most)
    return results.filter(F.col("page_no") <= most)


def running(df: DataFrame, group: list[str], order: list[Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows of its group up to this one, in an order that tells rows apart.

    bucket is a number or time that grows with the order: sums inside buckets run apart, and only one row a bucket meets in
    the window over a whole group, so that a few long groups don't make a few long tasks.
    """
    rows, keys = df.withColumn("_bucket", bucket), [*group, "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, inside).join(before, keys).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")

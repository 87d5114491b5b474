"""Weighted rendezvous hashing: every record goes to the shard whose draw for its key is best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadloom.llm.common import text_of

#: Blocks in each shard that are numbered apart, so that no task orders a whole shard.
BLOCKS = 256
#: The draw is a 52-bit part of an MD5 digest, so that every double holds it exactly.
DRAW_BITS = 52


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that the key and the shard decide."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit("/"), shard.cast("string")))
    return (F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(float(1 << DRAW_BITS))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (an index into weights) with the largest weight / -ln(draw). With a shard more, a key stays or goes to the new one.

    Equal weights compare the draws themselves. A weight of 0 gets no key. Ties go to the lower shard.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, nor all 0")
    shards = [i for i, w in enumerate(weights) if w > 0]
    equal = len({weights[i] for i in shards}) == 1

    def score(i: int) -> Column:
        u = draw(key, F.lit(i))
        return u if equal else F.lit(float(weights[i])) / -F.log(u)

    return F.array_max(F.array(*[F.struct(score(i).alias("score"), F.lit(-i).alias("minus")) for i in shards]))["minus"] * -1


def shard(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `shard`, `size` (UTF-8 bytes of the text and 1), `grown_shard` (with one more shard of mean weight) and `slot`.

    slot numbers the rows of a shard from 0 without gaps, by block of the key's hash, then key, then content. Rows with
    equal keys share a shard; a null key is a key of its own. Null texts have size 1. Works on empty tables. Columns of
    docs that clash with the new ones are replaced. Only keys, sizes and checksums are shuffled when the caller selects
    no text; each task numbers one block of a shard, and the starts of all blocks (BLOCKS for each shard at most, a
    fixed bound) are broadcast.
    """
    positive = [w for w in weights if w > 0]
    more = [*weights, sum(positive) / len(positive)]
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(BLOCKS)).cast("int")
    placed = docs.withColumns(
        {
            "size": (F.octet_length(text_of(text)) + 1).cast("long"),
            "text_crc32": F.crc32(F.encode(text_of(text), "utf-8")),
            "shard": rendezvous(F.col(key), weights).cast("int"),
            "grown_shard": rendezvous(F.col(key), more).cast("int"),
        }
    ).withColumn("_block", block)
    counts = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    return (
        placed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_block", "_start", "_rank")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, several files in each."""
    sharded.write.partitionBy("shard").parquet(path)


def placement(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's columns for `shards` equal shards."""
    out = shard(docs.select("doc_id", "text"), [1.0] * shards).drop("text")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

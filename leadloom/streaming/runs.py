"""Tables that streams keep up to date: rows by key, of which the winner by an order counts, whichever batch it came with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leadloom.operators.lookup import first_by
from leadloom.sources import versions


@dataclass(frozen=True)
class RunTable:
    """A batch's rows are a run of level 0 and are written without a look at earlier ones; `fan` runs of a level are merged into one of the next.

    Which runs count after batch n follows from n alone (its number of batches, written to base `fan`), so there is no list of
    runs to keep in step: a batch that is done again replaces its run and those it merges into. Each row is written once a level,
    that is a logarithm of the number of batches times. Runs are divided by a hash of the key: looking up keys reads their
    buckets only. A table belongs to one stream and its checkpoint, whose batches count from 0.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    order: list[Column]
    fan: int = 8
    buckets: int = 16

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level={level}/run={run}"

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        own = first_by(rows, [self.key], self.order).select(*self.schema.names, self._bucket())
        own.repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._folder(level, run))

    def _runs(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[self._folder(*r) for r in runs]).select(*schema.names)

    def live(self, batches: int) -> list[tuple[int, int]]:
        """The (level, run) pairs that hold all rows of so many batches."""
        out, level = [], 0
        while batches:
            out += [(level, batches - 1 - k) for k in range(batches % self.fan)]
            batches, level = batches // self.fan, level + 1
        return out

    def put(self, rows: DataFrame, batch: int) -> None:
        """Writes the rows of a batch, the winner of each key, and merges the runs that are due."""
        self._write(rows, 0, batch)
        n, level = batch + 1, 0
        while n % self.fan == 0:
            self._write(self._runs([(level, n - 1 - k) for k in range(self.fan)]), level + 1, n // self.fan - 1)
            n, level = n // self.fan, level + 1

    def batches(self) -> int:
        """So many batches can be read: the last with all its runs complete, so that one that is being written doesn't count."""
        done: dict[int, set[int]] = {}
        there = lambda level: done.setdefault(level, set(map(int, versions.complete(self.spark, f"{self.path}/level={level}"))))
        return next((n + 1 for n in sorted(there(0), reverse=True) if all(run in there(level) for level, run in self.live(n + 1))), 0)

    def read(self, batches: int | None = None) -> DataFrame:
        """The winner of each key after so many batches, by default all."""
        rows = self._runs(self.live(self.batches() if batches is None else batches))
        return first_by(rows, [self.key], self.order).select(*self.schema.names)

    def of(self, keys: DataFrame) -> DataFrame:
        """The winners of the given keys, from the buckets that can hold them."""
        wanted = keys.select(self.key, self._bucket()).distinct()
        rows = self._runs(self.live(self.batches())).join(wanted, ["_bucket", self.key], "left_semi")
        return first_by(rows, [self.key], self.order).select(*self.schema.names)

    def vacuum(self) -> int:
        """Removes runs that are merged into others, but for those of the last batch, and says how many."""
        n = self.batches()
        keep = {*self.live(n), *self.live(n - 1), (0, n - 1)} if n else set()
        old, level = 0, 0
        while n and (names := versions.complete(self.spark, f"{self.path}/level={level}")):
            for run in map(int, names):
                if (level, run) not in keep and run < n // self.fan**level:
                    versions.remove(self.spark, self._folder(level, run))
                    old += 1
            level += 1
        return old

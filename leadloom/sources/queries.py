"""Search queries from text files, tables and literals, and what remains of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.config import ENGINE_ALIASES, ENGINES
from leadloom.operators.lookup import first_by


def distinct_in_order(queries: DataFrame) -> DataFrame:
    """query, position -> each query once, at its first position; blank ones and comments go."""
    shown = queries.withColumn("query", F.trim("query")).filter("query <> '' and not startswith(query, '#')")
    return first_by(shown, ["query"], [F.col("position")])


def from_text(spark: SparkSession, path: str) -> DataFrame:
    """One query a line. Lines keep their order within a file by the id of the scan's rows."""
    return distinct_in_order(spark.read.text(path).select(F.col("value").alias("query"), F.monotonically_increasing_id().alias("position")))


def from_csv(spark: SparkSession, path: str, column: str | int = 0) -> DataFrame:
    table = spark.read.csv(path, header=True)
    name = table.columns[column] if isinstance(column, int) else column
    return distinct_in_order(table.select(F.col(f"`{name}`").alias("query"), F.monotonically_increasing_id().alias("position")))


def literal(spark: SparkSession, query: str) -> DataFrame:
    return distinct_in_order(spark.createDataFrame([(query, 0)], "query string, position long"))


def union_in_order(*sources: DataFrame) -> DataFrame:
    """All queries, those of earlier sources first, each once."""
    parts = [s.select("query", F.struct(F.lit(k).alias("source"), "position").alias("position")) for k, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_by(out, ["query"], [F.col("position")])


def resolve_engines(names: list[str]) -> list[str]:
    """Full names of known engines, each once, in order."""
    full = [ENGINE_ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names]
    return [n for n in dict.fromkeys(full) if n in ENGINES]

import random

from pyspark.sql import functions as F

from leadloom import catalog
from leadloom.operators import report
from tests.test_entry import DATA, db, rows_of  # noqa: F401


def test_quality_order_whole(spark, db):  # noqa: F811
    out = catalog.QUERIES["quality_order_whole"](spark, DATA)
    got, expected = [tuple(r) for r in out.collect()], db.execute(catalog.ORACLE_SQL["quality_order_whole"])
    assert rows_of((out.columns, got)) == rows_of(([c[0] for c in expected.description], expected.fetchall()))
    assert len(got) == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_places_over_many_ranges(spark):
    n = 3000
    scores = [(i, s) for i, s in enumerate(random.Random(1).choices(range(20), k=n))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = report.placed(spark.createDataFrame(scores, "i long, score int").repartition(5), F.desc("score"), F.col("i"))
        got = {r.i: r.place for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: k for k, (i, _) in enumerate(sorted(scores, key=lambda r: (-r[1], r[0])), 1)}

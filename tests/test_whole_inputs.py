import pytest

from leadloom import catalog
from tests.test_entry import DATA, db, rows_of  # noqa: F401


@pytest.mark.parametrize("name", ["english_filter_whole", "page_blocks_whole"])
def test_against_sql(spark, db, name):  # noqa: F811
    out = catalog.QUERIES[name](spark, DATA)
    got, expected = [tuple(r) for r in out.collect()], db.execute(catalog.ORACLE_SQL[name])
    assert rows_of((out.columns, got)) == rows_of(([c[0] for c in expected.description], expected.fetchall()))


def test_text_behind_the_old_cuts(spark, tmp_path):
    """Foreign text after character 92, and a captcha mark after character 1,900, count."""
    docs = [(1, "Short title. " + "plain words " * 10 + "слова " * 200), (2, "Short title. " + "plain words " * 100)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.english for r in catalog.QUERIES["english_filter_whole"](spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    pages = [(17, "u", "x" * 5000 + "Captcha"), (37, "u", "x" * 5000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.blocked for r in catalog.QUERIES["page_blocks_whole"](spark, str(tmp_path)).collect()} == {17: 1, 37: 0}

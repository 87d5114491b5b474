import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, start int, score double, row int, kept boolean"


@pytest.fixture(scope="session")
def docs(spark):
    """docs(rows): a documents table of (doc_id, text) or text rows, with extra columns whose names operators use too."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, None, "x", 7, 0.5, k, None) for k, (i, t) in enumerate(pairs)], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

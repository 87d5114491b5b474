import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    names = sorted(frame[0])
    return sorted(tuple(plain(v) for _, v in sorted(zip(frame[0], r, strict=True))) for r in frame[1]), names


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["url_normalise", "clean_variants", "query_union", "emails_all", "page_phones", "enrich_leads", "relevance_grade", "company_name", "page_health", "loop_detection", "truncate_after_ban"])
def test_against_sql(spark, db, name):
    catalog = importlib.import_module("leadloom.catalog")
    out = catalog.QUERIES[name](spark, DATA)
    expected = db.execute(catalog.ORACLE_SQL[name])
    assert rows_of((out.columns, [tuple(r) for r in out.collect()])) == rows_of(([c[0] for c in expected.description], expected.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_without_the_training_part(tmp_path):
    """The entry module imports, and other queries are there, when leadloom/llm and the pipeline are gone."""
    for p in ("__spark_entry__.py", "leadloom"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    llm = tmp_path / "leadloom" / "llm"
    if llm.exists():
        llm.rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'clean_results' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)

import pytest
from pyspark.sql import functions as F

from leadloom.llm import exact_dedup
from tests.llm.test_exact_dedup import brute, found


@pytest.mark.parametrize("fan_in", [2, 1_000])
def test_one_text_in_half_of_all_rows(docs, monkeypatch, fan_in):
    rows = [(i if i % 50 else None, "same text" + " " * (i % 3) if i % 2 else f"other {i // 4}") for i in range(600)]
    own = exact_dedup.index
    monkeypatch.setattr(exact_dedup, "index", lambda *a, **k: own(*a, **k, memtable_bytes=3_000, fan_in=fan_in))
    df = docs(rows)
    table = exact_dedup.index(df)
    assert table.count() == 600 and table.select("digest").distinct().count() == 151
    assert table.groupBy("digest").agg(F.max("runs").alias("n")).filter("n > 5").count() >= 1  # the hot text is in many runs
    assert found(df) == brute(rows)


def test_compaction_takes_no_members(docs, monkeypatch):
    """What meets in one task is a row for each run and bucket, whatever the number of copies."""
    seen = []
    real = exact_dedup._merged
    monkeypatch.setattr(exact_dedup, "_merged", lambda pdf: seen.append(pdf) or real(pdf))
    import numpy as np
    import pandas as pd

    blocks = [b for k in range(3) for b in exact_dedup.flush(k, {bytes(32): [b"", 0, k, [k] * 1000]}, 1, 1024)]
    pdf = pd.DataFrame([b for b in blocks if "bucket" in b])
    out = exact_dedup.settle(pdf)
    assert len(pdf) == 3 and out.group_size.tolist() == [3000] * 3 and out.keep_id.tolist() == [0] * 3 and out.runs.tolist() == [3] * 3
    assert "ids" not in pdf.columns and np.unique(out.grp).tolist() == [0, 1, 2]

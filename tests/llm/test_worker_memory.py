import subprocess
import sys

import pytest

from leadloom.llm import token_output

HELD = """
import re

import numpy as np
import pyarrow as pa

from leadloom.llm import common


def held():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10


last = []


def run(batches):
    for batch in batches:
        some = [np.ones(8000) for _ in range(1600)]  # 100 MB in pieces that the C library takes from its heap
        last.append(np.ones(8000))  # and one behind them that stays
        common._powers(1 << 22)
        yield batch


before = held()
for _ in common.tidy(run)([pa.RecordBatch.from_pydict({"a": [1]})]):
    pass
print(held() - before)
"""


def test_workers_give_memory_back():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 40


def test_units_are_bounded(docs, spark, tmp_path):
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    rows = [(k, "word " * 80_000) for k in range(5)]  # 400,000 bytes and some 80,000 ids each
    token_output.write_tokens(docs(rows).coalesce(1), str(tmp_path / "t"), path, unit_ids=200_000)
    assert max(r.n_ids for r in spark.read.parquet(str(tmp_path / "t")).collect()) <= 200_000
    assert token_output.UNIT_IDS <= 1 << 20  # what is coded side by side
    back = token_output.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r.doc_id for r in back] == [*range(5)] and [r.start for r in back] == [k * back[0].n_tokens for k in range(5)]
    assert len({r.ids_crc32 for r in back}) == 1

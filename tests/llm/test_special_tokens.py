import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from leadloom.llm import queries, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def plain(rows):
    """A tokenizer as it is loaded, told only to add no special tokens."""
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_and_stage(docs, spark, tmp_path):
    texts = ["a <|endoftext|> b", "after it", "x<|endoftext|>y", None, " two  <|endoftext|>", "  ", "<|endoftext|>"]
    docs([*enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain([*enumerate(texts)])
    assert want[0][2] < len("a <|endoftext|> b".split()) + 3
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in queries.op4_token_output(spark, str(tmp_path)).collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.write_token_files(spark, df, "").collect()) == want


def test_pieces():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "The", " ", " ", "<|endoftext|>", "\n", ".", "é", "<|", "|>"]) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    ids, sizes = token_output.Tokens(PATH, special=True).of(texts)
    ends = np.cumsum(sizes)
    got = [(n, zlib.crc32(ids[b - n : b].astype("<u4").tobytes())) for b, n in zip(ends, sizes, strict=True)]
    assert got == [x[2:] for x in plain([*enumerate(texts)])]

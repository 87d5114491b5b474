import random
import zlib

import numpy as np
import pytest

from leadloom.llm import context_coder, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def prose(n, seed=2):
    """Words from a few syllables, so that neither whole words nor lines recur much."""
    rng = random.Random(seed)
    part = ["th", "en", "ra", "on", "ti", "re", "ly", "sh", "ou", "en", "an", "st", "ing", "er"]
    return " ".join("".join(rng.choice(part) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def test_smaller_than_zlib_by_a_tenth():
    ids, _ = token_output.Tokens(PATH).of([prose(60_000)])
    blocks = context_coder.split(ids)
    assert len(blocks) > 1 and sum(map(len, blocks)) == len(ids) and max(map(len, blocks)) <= context_coder.BLOCK
    coded = context_coder.encode(blocks)
    assert sum(map(len, coded)) < 0.9 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    # any block alone, and any order of blocks
    assert (context_coder.decode(coded[1:2], [len(blocks[1])])[0] == blocks[1]).all()
    back = context_coder.decode(coded[::-1], [len(b) for b in blocks[::-1]])
    assert all((a == b).all() for a, b in zip(back, blocks[::-1], strict=True))


def test_sizes_around_the_bounds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 511, 512, 513, 1025, 65_535, 65_536, 65_537, 131_073):
        ids = rng.integers(0, 40, n).astype(np.uint16)
        blocks = context_coder.split(ids)
        back = context_coder.decode(context_coder.encode(blocks), [len(b) for b in blocks])
        assert sum(map(len, blocks)) == n and (np.concatenate([*back, ids[:0]]) == ids).all()


def test_pieces_of_many_alphabets():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(PATH), random.Random(7)
    part = ["a", "Word", " ", "  ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", "'s", "'", "12", "½", "é", "Ü", "漢字", "жук", "ß", "—", "…", "…x", "!", "?!", "'ll", "_", "²", "́", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choice(part) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" * 3000 + " y", "", " "]
    tokens = token_output.Tokens(PATH, special=True)
    for some in (texts, texts[::-1]):
        ids, sizes = tokens.of(some, end=None)
        assert ids.tolist() == [i for t in some for i in plain.encode(t, add_special_tokens=False).ids] and len(sizes) == len(some)

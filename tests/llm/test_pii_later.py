import random

import numpy as np
import pytest

from leadloom.llm import pii
from tests.llm.test_pii_recall import WORDS, ordinary


def prose(rng, k):
    return " ".join(rng.choice(WORDS) for _ in range(k))


def digits(rng, k):
    return "".join(rng.choice("123456789") for _ in range(k))


def later(rng, n):
    """Documents that give an address or a number and then, far on, what is left of it, in forms that the field isn't trained on too: (text, kind, what is left)."""
    out = []
    for k in range(n):
        a, b, c = digits(rng, 3), digits(rng, 3), digits(rng, 4)
        local = rng.choice([f"{rng.choice(['kim', 'lee', 'sam'])}.{digits(rng, 3)}", f"j_{rng.choice(['harbour', 'mill', 'north'])}"])
        first, kind, left = [
            (f"+1 ({a}) {b}-{c}", "phone", f"{b}{c}"), (f"+1 ({a}) {b}-{c}", "phone", f"{b}/{c}"), (f"+44 {a} {b} {c}", "phone", f"{b} {c}"),
            (f"+44 {a} {b} {c}", "phone", f"{a}/{b}/{c}"), (f"+1-{a}-{b}-{c}", "phone", f"{b}_{c}"), (f"{local}@mail.example.com", "email", local), (f"{local}@north.example.org", "email", local.title()),
        ][k % 7]
        out.append((f"{prose(rng, 20)} {first} {prose(rng, 25)} {left} {prose(rng, 10)}", kind, left))
    return out


def found(text, field, kind, left):
    body = text.encode()
    a = text.rindex(left)
    return any(pii.KINDS[k] == kind and p <= a + 1 and q >= a + len(left) - 1 for k, p, q in pii.added_spans(body, pii.base_spans(body), field))


@pytest.fixture(scope="module")
def field(spark):
    texts = ordinary(random.Random(5), 900)
    return pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_later_mentions_are_found_through_skip_edges(field):
    cases = later(random.Random(6), 350)
    hits = sum(found(*[c[0], field, c[1], c[2]]) for c in cases)
    assert hits >= 0.9 * len(cases)
    without = pii.SkipChainField()
    without.unary, without.chain, without.skip = field.unary, field.chain, np.zeros_like(field.skip)
    assert sum(found(c[0], without, c[1], c[2]) for c in cases) <= hits * 2 / 3


def test_numbers_that_nothing_tells_are_left_alone(field):
    rng = random.Random(7)
    wrong = 0
    for k in range(300):
        a, b, c = digits(rng, 3), digits(rng, 3), digits(rng, 4)
        first = [f"+1 ({digits(rng, 3)}) {digits(rng, 3)}-{digits(rng, 4)}", f"a{digits(rng, 2)}.b@mail.example.com", "nothing"][k % 3]
        other = [f"part {a}-{b}-{c}", f"{a}.{b}.{c} units", f"{b}{c}", f"{b} {c}", f"x.{a}", f"order {a}{b}{c}", f"{b}{c} and {b}{c}"][k % 7]
        body = f"{prose(rng, 20)} {first} {prose(rng, 20)} {other} {prose(rng, 10)}".encode()
        wrong += len(pii.added_spans(body, pii.base_spans(body), field))
    assert wrong <= 6


def test_edges_join_what_holds_the_same_digits():
    seq = pii.Sequence(b"call +44 20 7946 0958 or, as said, 020/79460958 or 7946-0958 again; 20 7946 0959 isn't")
    words = [w for _, w, _ in seq.words]
    assert {(words[a], words[b]) for a, b in seq.skip} == {(b"20", b"020/79460958"), (b"7946", b"020/79460958"), (b"0958", b"020/79460958"), (b"020/79460958", b"7946-0958")}
    seq = pii.Sequence(b"Jane.D9@x.org then (jane.d9) then info@x.org and info")
    assert [(seq.words[a][1], seq.words[b][1]) for a, b in seq.skip] == [(b"Jane.D9@x.org", b"(jane.d9)")]


def test_remembered_spans_are_where_they_say():
    for text in ordinary(random.Random(8), 100):
        body = text.encode()
        base = pii.base_spans(body)
        new, spans = pii.remembered(body, base)
        assert new.startswith(body) and spans[: len(base)] == base
        assert all(new[a:b].strip() == new[a:b] != b"" and new[a - 1 : a] == b" " for _, a, b in spans)

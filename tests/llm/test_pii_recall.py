import random

import pyarrow as pa

from leadloom.llm import pii

WORDS = "the water under every bridge was cold and people went on to find work in other towns before winter came".split()


def planted(rng, n):
    """Documents, each with something that no base pattern finds, and where that is (kind, text)."""
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    num = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    out = []
    for _ in range(n):
        name, host = rng.choice(["jo", "kim", "lee", "sam"]) + num(2), rng.choice(["harbour", "mill", "north"]) + num(1)
        card = num(15)
        card += next(d for d in "0123456789" if pii.luhn((card + d).encode()))
        kind, x = rng.choice([
            ("email", f"{name} (at) {host}.example.com"), ("email", f"{name} at {host} dot example dot com"), ("email", f"{name} [at] {host} [dot] example [dot] com"),
            ("phone", f"({num(3)}) {num(3)}-{num(4)}"), ("phone", f"{num(3)}-{num(3)}-{num(4)}"), ("phone", f"{num(3)}.{num(3)}.{num(4)}"),
            ("card", "_".join(card[i : i + 4] for i in range(0, 16, 4))), ("card", ".".join(card[i : i + 4] for i in range(0, 16, 4))), ("ip", f"{rng.randint(11, 99)}[.]{num(2)}[.]{num(2)}[.]{num(1)}"),
        ])
        out.append((f"{prose(30)} {x} {prose(30)}", kind, x))
    return out


def ordinary(rng, n):
    """Documents with base spans to learn from, and others with numerals that are nothing."""
    num = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    prose = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    out = []
    for k in range(n):
        card = num(15)
        card += next(d for d in "0123456789" if pii.luhn((card + d).encode()))
        x = [f"a{num(2)}.b@mail{num(1)}.example.com", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"{rng.randint(1, 99)}.{num(2)}.{num(2)}.{num(1)}", " ".join(card[i : i + 4] for i in range(0, 16, 4)), f"in 19{num(2)} for {num(2)}.{num(2)} at {num(4)} and 12-3-20{num(2)}", f"{num(3)},{num(3)} of {num(1)}/{num(2)}"][k % 6]
        out.append(f"{prose(20)} {x} {prose(20)}")
    return out


def test_what_the_patterns_miss(docs):
    rng = random.Random(11)
    cases, clean = planted(rng, 300), ordinary(rng, 900)
    texts = [t for t, _, _ in cases] + clean
    got = {r.doc_id: r for r in pii.find_pii(docs(texts)).collect()}
    hit = 0
    for i, (text, kind, x) in enumerate(cases):
        a, b = text.index(x), text.index(x) + len(x)
        spans = [(k, int(p), int(q)) for k, p, q in (s.split(":") for s in got[i].spans.split(",") if s)]
        base = {(pii.KINDS[k], p, q) for k, p, q in pii.base_spans(text.encode())}
        assert not any(k == kind and p <= a and b <= q for k, p, q in base)  # the patterns don't have it
        hit += any(k == kind and min(b, q) - max(a, p) >= 0.8 * (b - a) for k, p, q in spans)
    assert hit / len(cases) >= 0.9
    wrong = sum(got[len(cases) + k].n_added for k in range(len(clean)))
    assert wrong <= 0.02 * len(clean)


def test_perturbed_spans_are_where_they_say():
    rng = random.Random(3)
    for t in ordinary(rng, 200):
        body = t.encode()
        new, spans = pii.perturbed(body, pii.base_spans(body))
        assert all(0 <= a < b <= len(new) and new[a:b].strip() == new[a:b] for _, a, b in spans)
        assert [k for k, _, _ in spans] == sorted(k for k, _, _ in spans) or len({k for k, _, _ in spans}) > 1


def test_documents_without_signs_have_no_nodes():
    assert pii.Sequence("at home we look at the dotted line, Ünï".encode()).spans == []
    assert [pii.Sequence(b"x at y dot z").words[k][1] for k in (0, -1)] == [b"x", b"z"]
    assert pa.array(pii.Sequence(b"a 1 b 2").features()).type is not None

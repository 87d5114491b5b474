import hashlib
import random
import re

import pytest

from leadloom.llm import pii, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_secrets(t):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def brute_pii(t):
    s = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)] + [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d.encode()):
            s.append((2, m.start(), m.end()))
    s += [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(s)


def test_base_patterns_at_random():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "b", "@", ".", "_", "1", "4111111111111111", "+", "-", " ", "(", "256", "10.0.0.1", "é"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t.encode()) == [(k, len(t[:a].encode()), len(t[:b].encode())) for k, a, b in brute_pii(t)]
        t = "".join(rng.choice(["token", "=", '"', " ", "Api_Key", ":", "abcdef", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef0123", "é", "ſecret"]) for _ in range(rng.randint(0, 20)))
        base, _, points = secrets.scan(t, secrets.Novelty())
        assert secrets._render(base, points) == brute_secrets(t)


def test_secrets(docs, small):
    key = "Zx81Qm4Tn7Vb2Lk9Wc5Jh3Ry6Pd0"
    texts = [f"é my password: {key[:8]} end", None, "", f"Authorization: Bearer {key}", "bearer of_the_configuration_database_connection_password", f"no context {key}", "token=" + "ab" * 100_000, "a" * 300_000]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(brute_secrets(t or "").encode()).hexdigest()
    assert got[0].spans == "assign:5:23" and got[3].spans == "novel:22:50" and got[3].n_novel == 1
    assert got[1].spans == got[2].spans == got[4].spans == got[5].spans == ""
    assert secrets.redact(f"Authorization: Bearer {key}.", got[3].spans) == "Authorization: Bearer [secret]."
    assert secrets.find_secrets(docs([])).count() == 0
    whole = {r.doc_id: r.base_sha256 for r in secrets.find_secrets(small).collect()}
    assert whole == {r.doc_id: hashlib.sha256(brute_secrets(r.text).encode()).hexdigest() for r in small.collect()}


def test_novelty_sees_the_code_around():
    n, key = secrets.Novelty(), b"Zx81Qm4Tn7Vb2Lk9Wc5Jh3Ry6Pd0"
    assert n.bits(key, b"") > secrets.NOVELTY > n.bits(key, b"x = '" + key + b"'") and n.bits(b"connection_configuration", b"") < secrets.NOVELTY


def test_pii(docs, small):
    texts = [f"call +1 (286) 555-51{i:02d} or mail a.b{i}@mail.example.com from 10.1.2.{i}" for i in range(40)]
    texts += [None, "", "9" * 100_000, "1.1.1.1" * 20_000, "é +44 20 7946 0958, 4111 1111 1111 1111", "a@" * 50_000, "."]
    got = {r.doc_id: r for r in pii.find_pii(docs(texts)).collect()}
    for i, t in enumerate(texts):
        if t != "9" * 100_000:
            assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_pii(t or "")).encode()).hexdigest()
    # the patterns take hours on so many digits; as on fewer, nothing in them is personal
    assert brute_pii("9" * 3000) == [] and got[42].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[44].n_card, got[44].n_phone, got[44].spans) == (1, 1, "card:20:39,phone:2:18")
    assert got[40].n_email == 0 and got[42].n_card == 0
    assert pii.find_pii(docs([])).count() == 0 and pii.find_pii(docs([(None, "a@b.co"), (None, "a@b.co")])).count() == 2
    whole = {r.doc_id: r.base_sha256 for r in pii.find_pii(small).collect()}
    assert whole == {r.doc_id: hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_pii(r.text)).encode()).hexdigest() for r in small.collect()}


def test_skip_edges_carry_labels():
    """A token without evidence of its own takes the label of the equal token far away; without the edge it doesn't."""
    rng, docs_ = random.Random(2), []
    for _ in range(300):
        n = f"{rng.randint(10**6, 10**7 - 1)}"
        body = f"dial +1-555-{n[:3]}-{n[3:]} now words here then +1-555-{n[:3]}-{n[3:]} end year 19{rng.randint(10, 99)}".encode()
        seq = pii.Sequence(body)
        docs_.append((seq.features(), seq.silver(pii.base_spans(body)), seq.chain, seq.skip))
    field = pii.SkipChainField().fit(docs_)
    assert field.skip[4, 4] > 0 and field.skip[4, 4] > field.skip[0, 4]
    weak = [[pii.FEATURES], docs_[0][0][0]]
    weak[0] = weak[0] * len(weak[1])
    alone, beside = field.beliefs(weak, [], [])[0, 4], field.beliefs(weak, [], [(0, 1)])[0, 4]
    assert beside > alone


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("4111111111111112", False), ("0" * 13, True)])
def test_luhn(digits, ok):
    assert pii.luhn(digits.encode()) is ok

import base64
import random
import string

from leadloom.llm import secrets

LETTERS = string.ascii_letters + string.digits
WORDS = """harbour mill north water under bridge garden memories chapter bread make how blog week winter towns people travel customer
invoice shipping address holiday picture kitchen silver mountain river planning weather teacher student history science future
market report summary annual meeting project budget engineer design review""".split()
CONTEXTS = ["the token for this is {} as of now", "Authorization: Bearer {}", "secret `{}` in the file", "our private one, {}, of last week", "credentials go to {} then"]


def keys(rng, n):
    run = lambda k, letters=LETTERS: "".join(rng.choice(letters) for _ in range(k))
    head = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=")
    for k in range(n):
        yield [
            run(rng.randint(18, 40)), base64.b64encode(rng.randbytes(rng.randint(18, 60))).decode().rstrip("="), f"{head}.{run(40, LETTERS + '-_')}x.{run(43)}",
            run(rng.randint(16, 24), LETTERS + "@#$%") + "x1", run(rng.randint(20, 32), string.ascii_uppercase + string.digits), "ghp_" + run(36), "key_live_" + run(28), run(22, "0123456789ABCDEF"), run(12, LETTERS) + "+" + run(12, LETTERS) + "/" + run(14),
        ][k % 9]


def names(rng, n):
    yield from ["UserAccountManager2024Service", "garden-of-memories_chapter12", "com/blog/2024/05/06/how-to-make-bread"]
    for k in range(3, n):
        a, b, c, d = rng.sample(WORDS, 4)
        day = f"20{rng.randint(10, 25)}/0{rng.randint(1, 9)}/{rng.randint(10, 28)}"
        yield [
            f"{a}-of-{b}_{c}{rng.randint(1, 20)}", f"com/{a}/{day}/{b}-to-{c}-{d}", f"{a.title()}{b.title()}{c.title()}{rng.randint(1990, 2030)}Service", f"{a}_{b}_v{rng.randint(1, 9)}_{c}", f"{a}.{b}.{c}{rng.randint(1, 9)}",
            f"get{a.title()}{b.title()}By{c.title()}Id2", f"{a}.{b}{rng.randint(1, 99)}@{c}.example.com", f"{a.upper()}_{b.upper()}_{rng.randint(1, 99)}_{c.upper()}", f"{day.replace('/', '-')}_{a}-{b}.{c}",
        ][k % 9]


def added(text):
    base, spans, points = secrets.scan(text, secrets.Novelty())
    return [(text[points[a] : points[b]], points[a], points[b]) for a, b, _ in (*base, *spans)]


def test_keys_are_told_from_names():
    rng = random.Random(21)
    found = sum(any(x == key for x, _, _ in added(rng.choice(CONTEXTS).format(key))) for key in keys(rng, 500))
    wrong = sum(bool(added(rng.choice(CONTEXTS).format(name))) for name in names(rng, 500))
    assert found >= 450 and wrong <= 50 and found / (found + wrong) >= 0.9


def test_novelty_decides():
    """The same characters are reported, or not, by what the compressor knows."""
    key = "Zx81Qm4Tn7Vb2Lk9Wc5Jh3Ry6Pd0"
    assert [x for x, _, _ in added(f"Bearer {key}")] == [key]
    assert added(f"Bearer {key} is the public id {key} of {key}") == []
    assert [n for n in names(random.Random(3), 3) if added(f"secret `{n}`")] == []
    # a sign at the end of a sentence isn't the key's, one inside is
    assert [x for x, _, _ in added("the token Qx7@pL2#vN9$kR4%tB8z! Then")] == ["Qx7@pL2#vN9$kR4%tB8z"]


def test_repeats_have_no_price():
    n = secrets.Novelty()
    assert n.bits(b"a1" * 2_000, b"") < 0.1 and n.bits(b"Ab1" * 2_000, b"") < 0.1
    assert secrets.spelled(b"getUserById2 X9aB") == b"get_user\x01by\x01id\x012 x\x019\x01a\x01b"

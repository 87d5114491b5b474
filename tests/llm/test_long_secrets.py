import random
import string

from leadloom.llm import secrets


def letters(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_long_secrets_whole(docs):
    key = letters(5000, 1)
    padded = letters(200, 2) + "A" * 4000
    texts = [f"é Authorization: Bearer {key}.", f"Bearer {padded} end", "token " * 50_000, "Bearer " + "a1" * 200_000, f"{'Bearer ' * 3}{letters(16, 3)}"]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(texts)).collect()}
    assert got[0].spans == "novel:24:5024"
    assert secrets.redact(texts[0], got[0].spans) == "é Authorization: Bearer [secret]."
    assert got[1].spans == f"novel:7:{7 + len(padded)}"
    assert got[2].n_novel == got[3].n_novel == 0 and got[4].n_novel == 1


def test_parts_beside_base_spans():
    """A base span inside a long run doesn't take the rest of the run out."""
    head, tail = letters(400, 4), letters(400, 5)
    text = f"Bearer {head}-{'deadbeef' * 3}-{tail}"
    base, added, _ = secrets.scan(text, secrets.Novelty())
    a = text.index("deadbeef")
    hexes = [(x, y) for x, y, k in base if k == 2]
    assert any(x <= a and y >= a + 24 for x, y in hexes)
    assert len(added) == 2 and added[0][0] == 7 and added[0][1] == hexes[0][0] and added[1][0] == hexes[-1][1] and added[1][1] == len(text)

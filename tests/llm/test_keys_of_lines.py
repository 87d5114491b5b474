import base64
import random

from leadloom.llm import secrets


def test_a_key_of_several_lines():
    raw = base64.b64encode(random.Random(4).randbytes(600)).decode()
    lines = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    for sep in ("\n", "\r\n", '\\n" +\n    "'):
        text = f"intro\n-----BEGIN PRIVATE KEY-----\n{sep.join(lines)}\n-----END PRIVATE KEY-----\nThe configuration of the connection follows.\n" + "ordinary words of a text " * 20
        base, added, points = secrets.scan(text, secrets.Novelty())
        found = {text[points[a] : points[b]] for a, b, _ in added}
        assert set(lines[:-1]) <= found and all(f in raw for f in found)
    # lines of ordinary text after a word are no key, and a key far from any sensitive word isn't either
    text = "token\n" + "\n".join(["configuration_of_the_connection", "description_of_the_environment"] * 5)
    assert secrets.scan(text, secrets.Novelty())[1] == [] and secrets.scan("\n".join(lines), secrets.Novelty())[1] == []

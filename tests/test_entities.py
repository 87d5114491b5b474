import html
import random
from html.entities import html5

from leadloom.functions.entities import decode_entities


def test_every_name_and_many_numbers(spark, values):
    texts = [f"x&{name}y {k}" for k, name in enumerate(html5)] + [f"&{name}" for name in html5]
    texts += [f"a&#{n};b&#x{n:X};c&#{n}d" for n in [*range(0, 700), 8211, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFE, 0x10FFFF, 0x110000, 9_999_999, 10_000_000, 1 << 40]]
    rng = random.Random(1)
    part = ["&", "&amp", ";", "#", "x", "41", "&#", "&#x", "lt", "eacute;", "copy", "not", "it;", " ", "é", "&notin;", "&unknown;", "&#00065;", "&#X0041", "&CounterClockwiseContourIntegral;"]
    texts += ["".join(rng.choice(part) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["no reference", "", None]
    assert values(decode_entities, *texts) == [None if t is None else html.unescape(t) for t in texts]

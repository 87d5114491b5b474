"""Secrets: fixed patterns, and strings in sensitive contexts that zstandard can't shrink."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import code_points, merged, steps, text_of

# The base patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows them sensitive, and how far they reach.
SENSITIVE = (b"passw", b"passphrase", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"access_key", b"accesskey", b"private", b"credential", b"bearer", b"authorization", b"signature", b"client_id", b"akia")
REACH = 64
#: Candidates: least length in characters, and the least compressed bytes they, or their head, must add for each of their own.
SHORTEST, HEAD = 16, 200
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.!@#$%%^&*~-]{%d,}" % SHORTEST)
#: Signs that end a sentence rather than a candidate.
MARGIN = b".!*"
NOVELTY = 1.0
#: Level of compression, bytes of the dictionary's tables and samples, forms of identifiers that it is trained on, and the length of the text before a candidate.
LEVEL, TRAINED, FORMS, LEAD = 12, 16_384, 8_000, 256
#: Where a new word of a compound name starts, and other places where letters, capitals and numerals change.
COMPOUND = re.compile(rb"(?<=[a-z0-9])(?=[A-Z][a-z]{2})|(?<=[A-Z])(?=[A-Z][a-z]{2})")
CHANGE = re.compile(rb"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z0-9][A-Z])(?=[a-z])")
#: The end of a line and what may stand around it where a key is broken.
LINE = re.compile(rb"[\x20\x09\"'\\+,nr]{0,8}\r?\n[\x20\x09\"'>#*]{0,16}")
#: Bytes of code on each side that prime the compressor.
AROUND = 2048
#: Identifiers and literals that code is full of.
IDENTIFIERS = b"""
abstract application argument array async attribute authentication authorization authorize await background base64 boolean
buffer certificate character class client_id client_secret collection command component config configuration connection
connectionString const constructor content controller create_engine credentials database datetime decrypt default define
definition delete description dictionary directory document element encoding encrypt endpoint enumerate environment error
example exception execute export expression extends factory false filename fingerprint float format function generator
get_secret handler hashlib header headers hexdigest implementation implements import include information initialize instance
integer interface iterator javascript json keyword lambda language length library listener localhost logger management message
metadata method middleware module monitor namespace navigation notification null number object operation option organization
override package parameter password path pattern permission placeholder pointer postgresql prefix private process production
properties protected protocol public query random reference register repository request require resource response return
schema secret_key select serialize server service session settings signature socket source static status storage string struct
subscription suffix template test_token timeout timestamp token transaction transform true undefined unsigned update username
utf-8 validate value variable version virtual warning websocket your_api_key_here xxxxxxxxxxxxxxxx changeme 0123456789abcdef
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000000000000000
"""


def spelled(raw: bytes) -> bytes:
    """Lower-cased, the words of compound names apart; every other change between letters, capitals and numerals is a byte of its own, so that it has its price."""
    return CHANGE.sub(b"\x01", COMPOUND.sub(b"_", raw)).lower()


@cache
def trained() -> bytes:
    """A zstandard dictionary whose tables know how identifiers are written: names of one to three words in the usual forms."""
    rng = random.Random(0)
    words = [w for w in IDENTIFIERS.split() if w.isalpha() and len(w) < 20]
    samples = []
    for k in range(FORMS):
        w = [x.lower() for x in rng.sample(words, 3)]
        samples.append((b"_".join(w), b"-".join(w), b".".join(w), b"/".join(w), b"_".join(w[:2]), b" ".join(w), w[0] + b"_%d" % rng.randint(1, 2030), b"%s-v%d.%d" % (w[0], rng.randint(1, 9), rng.randint(0, 20)))[k % 8])
    return zstandard.train_dictionary(TRAINED, samples, level=3).as_bytes()


@cache
def lead() -> bytes:
    """Letters as frequent as in identifiers, in no order: what stands before a candidate, so that a short one pays no more for a block than its part."""
    letters = bytes(c for c in IDENTIFIERS.lower() if 97 <= c <= 122) + b"_./-" * 30
    return bytes(random.Random(1).choices(letters, k=LEAD))


class Novelty:
    """Marginal compressed bytes of a string, with dictionaries of identifiers and of the code around it."""

    def __init__(self, level: int = LEVEL):
        self.level = level

    def bits(self, candidate: bytes, around: bytes) -> float:
        """Compressed bytes that the candidate, as spelled(), adds to what the dictionaries tell, for each byte of it.

        The dictionary is trained on forms of identifiers, so letters have prices by their frequency there; its text is
        the identifiers and what stands around the candidate.
        """
        dictionary = zstandard.ZstdCompressionDict(trained() + IDENTIFIERS + spelled(around), dict_type=zstandard.DICT_TYPE_FULLDICT)
        packer = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
        empty = len(packer.compress(lead()))
        return (len(packer.compress(lead() + spelled(candidate))) - empty) / max(1, len(candidate))


def base_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns in bytes; all of them are ASCII, so bytes and characters find the same."""
    out = []
    low = body.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if b"AKIA" in body:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(body) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(body)]
    return out


def novel_spans(body: bytes, known: list[tuple[int, int, int]], novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Candidates that start within REACH of a sensitive word, whole but for the known spans, that stay incompressible."""
    low = body.lower()
    cover = merged([(a, b) for a, b, _ in known])
    marks = sorted(p for w in SENSITIVE if w in low for p in (m.end() for m in re.finditer(re.escape(w), low)))
    out, done = [], 0
    for mark in marks:
        done = max(mark, done)
        # the search ends where no candidate can start any more; what it finds goes on to its own end
        m = CANDIDATE.search(body, done, mark + REACH + SHORTEST)
        while m:
            start, done = m.start(), CANDIDATE.match(body, m.start()).end()
            before = len(out)
            for a, b in _apart(start, done, cover):
                found = body[a:b].rstrip(MARGIN)
                b = a + len(found)
                found = found.lstrip(MARGIN)
                a = b - len(found)
                if b - a < SHORTEST or not (re.search(rb"[0-9]", found) and re.search(rb"[A-Za-z]", found)):
                    continue
                around = body[max(0, a - AROUND) : a] + body[b : b + AROUND]
                if novelty.bits(found, around) >= threshold or b - a > HEAD and novelty.bits(found[:HEAD], around) >= threshold:
                    out.append((a, b, 3))
            # a key of several lines: what stands at the start of the next line goes with what was found
            line = LINE.match(body, done) if len(out) > before else None
            m = (line and CANDIDATE.match(body, line.end())) or CANDIDATE.search(body, done, mark + REACH + SHORTEST)
    return out


def _apart(start: int, end: int, cover: list[int]) -> Iterator[tuple[int, int]]:
    """The parts of a span outside the cover that are long enough for candidates."""
    k = bisect_right(cover, start)
    at = cover[k] if k % 2 else start
    for a, b in zip(cover[k + k % 2 :: 2], cover[k + k % 2 + 1 :: 2], strict=True):
        if a >= end:
            break
        if a - at >= SHORTEST:
            yield at, a
        at = b
    if end - at >= SHORTEST:
        yield at, end


def _render(spans: list[tuple[int, int, int]], points: dict[int, int]) -> str:
    return ",".join(f"{KINDS[k]}:{points[a]}:{points[b]}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], dict[int, int]]:
    """Base spans, added spans (both in bytes), and the code points of their bounds."""
    body = text.encode("utf-8", "surrogatepass")
    base = base_spans(body)
    added = novel_spans(body, base, novelty)
    at = [p for a, b, _ in (*base, *added) for p in (a, b)]
    return base, added, dict(zip(at, code_points(text, body, at), strict=True))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for every row of docs.

    Whole texts are read; null counts as empty and has no spans. Rows that repeat a doc_id are rows of their own; an
    empty table gives an empty one; other columns aren't read. Spans are in code points, the end exclusive. A novel span
    is of a run of SHORTEST bytes or more, of any length, that starts within REACH bytes of a sensitive word, or on the line
    after such a one; it overlaps no base span, has letters and digits, and adds (or its first HEAD bytes add) at least
    NOVELTY compressed bytes a byte when zstandard is primed with the code around it and a dictionary of identifiers.
    Names, paths, dates and addresses made of words shrink below that. Runs of digits alone aren't candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for step in steps(batch):
                rows = []
                for i, t in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist(), strict=True):
                    base, added, points = scan(t, novelty)
                    n = [sum(k == x for _, _, k in base) for x in range(3)]
                    rows.append((i, *n, hashlib.sha256(_render(base, points).encode()).hexdigest(), _render(base + added, points), len(added)))
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with its spans replaced."""
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if b > at:
            out += [text[at : max(a, at)], mark if a >= at else ""]
            at = b
    return "".join([*out, text[at:]])

"""Personal data: fixed patterns, and a skip-chain conditional random field over the tokens that look like it."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import code_points, merged, steps, text_of

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A lookbehind or possessive repeat only keeps a search from starting again inside a run that has failed.
LOCAL = re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
LOCAL_HERE = re.compile(rb"[A-Za-z0-9._%+-]++@")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NUMERAL, RUNS = re.compile(rb"[0-9]"), re.compile(rb"[0-9]+")
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")

#: Spelled-out signs of an address, with or without brackets around them.
SIGN = re.compile(rb"[\[({<]?(at|dot)[\])}>]?", re.I)
SPELLED = re.compile(rb"[\[({<](?:at|dot)[\])}>]|\x20dot\x20", re.I)
#: A local part that isn't just a word, so that it can be known again where it stands alone.
NAME = re.compile(rb"(?=[0-9._%+-]*[a-z])(?=[a-z]*[0-9._%+-])[a-z0-9._%+-]{5,64}")
#: Signs around a token that aren't its own.
MARGIN = b".,;:!?#$%&*|()<>[]{}\"'"
#: Digits at the end that make two numbers the same, and digits that are looked at.
SAME, FAR = 7, 15
#: Words before a number, or after it, that make it a thing's, and words before it that make it a person's.
THING = frozenset(b"part item model order invoice serial sku version section lot batch ref reference isbn article ticket case code chapter units items pieces pages boxes copies".split())
PERSON = frozenset(b"tel telephone phone call fax mobile cell text reach dial ring whatsapp".split())
#: Documents that the field is fitted on at most, their nodes at most, passes over them, and the belief from which a token is reported.
SAMPLE_DOCS, SAMPLE_NODES, EPOCHS, BELIEF = 3_000, 250, 40, 0.9
#: Weight of an unlabelled node that could be personal data in another form.
DOUBT = 0.004
#: Hash bins of the features, rounds of message passing.
FEATURES, ROUNDS = 1 << 12, 8
#: Label 0 is "none of them"; the others follow KINDS.
LABELS = 1 + len(KINDS)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, in order; all patterns are ASCII, so bytes and characters find the same."""
    out = []
    if b"@" in body:
        at = 0
        m = LOCAL.search(body)
        while m:
            d = DOMAIN.match(body, m.end())
            if d:
                out.append((0, m.start(), d.end()))
            at = d.end() if d else m.end()
            m = (d and LOCAL_HERE.match(body, at)) or LOCAL.search(body, at)
    if NUMERAL.search(body):
        for m in IP.finditer(body):
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m.group().split(b".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(body):
            if m.end() - m.start() >= 13:
                digits = m.group().translate(None, b" -")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if b"+" in body:
            for m in PHONE.finditer(body):
                if 9 <= len(NUMERAL.findall(m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def _written_otherwise(kind: int, raw: bytes, k: int) -> list[bytes]:
    """A span in a form that its pattern misses, in the pieces that blanks part."""
    digits = b"".join(NUMERAL.findall(raw))
    if kind == 0:
        local, _, domain = raw.partition(b"@")
        return ([local, b"(at)", domain], [local, b"[at]", *domain.replace(b".", b" [dot] ").split()], [local, b"at", *domain.replace(b".", b" dot ").split()], [local + b"(at)" + domain])[k % 4]
    if kind == 1:
        return ([raw.replace(b".", b"[.]")], [raw.replace(b".", b"(.)")])[k % 2]
    if kind == 2:
        parts = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return ([b".".join(parts)], [b"_".join(parts)], [b"/".join(parts)])[k % 3]
    end = digits[-10:]
    new = ([b"(" + end[:-7] + b")", end[-7:-4] + b"-" + end[-4:]], [b"-".join([end[:-7], end[-7:-4], end[-4:]])], [b".".join([end[:-7], end[-7:-4], end[-4:]])], raw.replace(b"+", b"").split(), [b"00" + digits], [b"0" + end])[k % 6]
    return [(b"tel", b"call", b"phone", b"mobile")[k // 12 % 4], *new] if k // 6 % 2 or k % 6 == 5 else new


def perturbed(body: bytes, base: list[tuple[int, int, int]]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text with its base spans written otherwise, and where they are then: what the field learns forms from."""
    out, spans, at, size = [], [], 0, 0
    for kind, a, b in sorted(base, key=lambda x: x[1]):
        if a < at:
            continue
        new = b" ".join(_written_otherwise(kind, body[a:b], zlib.crc32(body[a:b])))
        word = len(new.split()[0]) + 1 if new.split()[0] in PERSON else 0
        size += a - at
        spans.append((kind, size + word, size + len(new)))
        out += [body[at:a], new]
        size += len(new)
        at = b
    return b"".join([*out, body[at:]]), spans


def _bare(kind: int, raw: bytes, k: int) -> bytes:
    """What is left of a span where it is mentioned again, or nothing: what only the earlier mention tells."""
    digits = b"".join(NUMERAL.findall(raw))
    if kind == 0:
        local = raw.partition(b"@")[0].lower().strip(MARGIN)
        return local if NAME.fullmatch(local) else b""
    if kind == 1:
        return raw.replace(b".", b"-")
    if kind == 2:
        return b""
    rest = b" ".join(raw.split()[1:])
    return (rest if len(NUMERAL.findall(rest)) >= SAME else digits[-8:], digits[-7:-4] + b"-" + digits[-4:], digits[-10:], digits[-8:-4] + b" " + digits[-4:])[k % 4]


def remembered(body: bytes, base: list[tuple[int, int, int]]) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text as it is, then two bare later mentions of each of its base spans between words of its own, and others like them.

    What the field learns skip edges from. The others have changed digits, once or twice, or a thing's word beside them;
    their kind is -1: told to be nothing.
    """
    words = [w for w in TOKEN.findall(body[:4_000]) if w.isalpha()][:40] or [b"and"]
    out, spans, size = [body], list(base), len(body)

    def put(kind: int, new: bytes, k: int, before: bytes = b"", after: bytes = b"") -> None:
        nonlocal size
        lead = b" ".join([b"", words[k % len(words)], words[(k >> 8) % len(words)], *([before] if before else [])]) + b" "
        tail = b" ".join([b"", *([after] if after else []), words[(k >> 16) % len(words)]])
        spans.append((kind, size + len(lead), size + len(lead) + len(new)))
        out.append(lead + new + tail)
        size += len(lead) + len(new) + len(tail)

    for kind, a, b in base[:20]:
        raw = body[a:b]
        k = zlib.crc32(raw)
        new = _bare(kind, raw, k)
        if not new:
            continue
        for j in range(2):
            put(kind, new, k >> j)
        other = new.translate(bytes.maketrans(b"0123456789", b"7418529630"))
        if kind != 3 or k % 4:
            for _ in range(1 + k // 4 % 2):
                put(-1, other, k >> 1)
        if kind == 3 and k // 512 % 3 == 0:
            end = b"".join(NUMERAL.findall(raw)).translate(bytes.maketrans(b"0123456789", b"2345678901"))[-10:]
            sign = (b"-", b".", b" ", b"")[k // 8 % 4]
            thing = sorted(THING)[k // 32 % len(THING)]
            put(-1, sign.join([end[:-7], end[-7:-4], end[-4:]]), k >> 2, *((b"", thing) if thing.endswith(b"s") else (thing, b"")))
    return b"".join(out), spans


class Sequence:
    """The tokens of a document that could be personal data, and the edges between them.

    Nodes are tokens with a numeral or an @, and spelled-out signs of an address with the tokens beside them: those in
    brackets, and a bare "at" that a "dot" follows; besides, local parts of addresses where they stand alone, if they aren't
    just letters. Chain edges join tokens next to each other. Skip edges join distant tokens that are the same or similar:
    the same address or local part, the same four numbers, or numbers (of one token or of several in a row, however
    parted) whose last seven digits are equal; of these, tokens that hold the same digits are joined. A token is joined to
    the last one before it, so edges grow with the tokens.
    """

    def __init__(self, body: bytes):
        spelled = SPELLED.search(body) is not None
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(body)] if spelled or b"@" in body or NUMERAL.search(body) else []
        words = [body[a:b] for a, b in tokens]
        node = [bool(b"@" in w or NUMERAL.search(w)) for w in words]
        if spelled:
            sign = [m.group(1).lower() if (m := SIGN.fullmatch(w)) else None for w in words]
            for k, w in enumerate(words):
                if sign[k] and (not w.isalpha() or any(sign[j] and sign[j] != sign[k] for j in range(max(0, k - 4), min(len(words), k + 5)))):
                    for j in range(max(0, k - 1), min(len(words), k + 2)):
                        node[j] = True
                elif SPELLED.search(w):
                    node[k] = True
        self.names = {n for w in words if b"@" in w and NAME.fullmatch(n := w.partition(b"@")[0].lower().strip(MARGIN))}
        if self.names:
            node = [x or w.lower().strip(MARGIN) in self.names for x, w in zip(node, words, strict=True)]
        place = [k for k, x in enumerate(node) if x]
        self.spans = [tokens[k] for k in place]
        self.words = [(words[k - 1] if k else b"", words[k], words[k + 1] if k + 1 < len(words) else b"") for k in place]
        self.chain = [(i - 1, i) for i in range(1, len(place)) if place[i] == place[i - 1] + 1]
        digits = [b"" if b"@" in w else b"".join(NUMERAL.findall(w))[-FAR:] for _, w, _ in self.words]

        def tail(i: int) -> list[tuple[int, int, int]]:
            """Tokens of the number that ends with token i, the last one first, and their digits' places from the end."""
            out = [(i, 0, len(digits[i]))]
            while i and out[-1][2] < FAR and place[i - 1] + 1 == place[i] and digits[i - 1]:
                i -= 1
                out.append((i, out[-1][2], out[-1][2] + len(digits[i])))
            return out

        last: dict[bytes, int] = {}
        skip: dict[tuple[int, int], None] = {}
        for i, (_, w, _) in enumerate(self.words):
            if SIGN.fullmatch(w):
                continue
            low = w.lower().strip(MARGIN)
            parts = RUNS.findall(w) if b"@" not in w else ()
            for key in {low, low.partition(b"@")[0]} if b"@" in w or low in self.names else {b" ".join(parts)} if len(parts) == 4 else ():
                if key in last and place[last[key]] + 1 != place[i]:
                    skip[last[key], i] = None
                last[key] = i
            if not digits[i] or low in self.names:
                continue
            mine = tail(i)
            number = b"".join(digits[k] for k, _, _ in reversed(mine))
            key = b"#" + number[-SAME:]
            if len(number) >= SAME and key in last:
                before = tail(last[key])
                other = b"".join(digits[k] for k, _, _ in reversed(before))
                same = next((n for n in range(min(len(number), len(other))) if number[-1 - n] != other[-1 - n]), min(len(number), len(other)))
                for k, p, q in mine:
                    for j, x, y in before:
                        if place[j] + 1 < place[k] and max(p, x) < min(q, y, same):
                            skip[j, k] = None
            if len(number) >= SAME:
                last[key] = i
        self.skip = list(skip)

    def features(self) -> list[list[int]]:
        def shape(w: bytes) -> str:
            return re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", w[:40].decode("latin-1").lower())))

        out = []
        for before, w, after in self.words:
            digits = b"".join(NUMERAL.findall(w))
            n = len(digits)
            own = [
                f"n{min(n, 20)}", f"@{w.count(b'@')}", f".{min(w.count(b'.'), 4)}", f"-{min(w.count(b'-'), 3)}",
                f"+{w[:1] == b'+'}", f"({b'(' in w}{b')' in w}", f"len{min(len(w) // 4, 12)}", f"abc{any(97 <= c | 32 <= 122 for c in w)}",
                f"luhn{13 <= n <= 19 and luhn(digits)}", "shape" + shape(w), "runs" + "-".join(str(len(x)) for x in RUNS.findall(w)[:8]), "sign" + (w.lower().decode("latin-1") if SIGN.fullmatch(w) else ""),
                "before" + before[:20].decode("latin-1").lower(), "beforeshape" + shape(before), "aftershape" + shape(after),
                "signs" + "".join(str(int(SIGN.fullmatch(x) is not None)) for x in (before, after)),
                f"thing{before.lower().strip(MARGIN) in THING or after.lower().strip(MARGIN) in THING}", f"person{before.lower().strip(MARGIN) in PERSON or w.lower().partition(b':')[0] in PERSON}",
            ]
            out.append([zlib.crc32(f.encode()) % FEATURES for f in own] + [FEATURES])
        return out

    def silver(self, base: list[tuple[int, int, int]]) -> np.ndarray:
        """A label for each node: that of the base span which overlaps it (of several, the last kind)."""
        return self.told(base)[0]

    def told(self, base: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """A label for each node, that of the span which overlaps it (of several, the last kind), and whether one does."""
        out, told = np.zeros(len(self.spans), np.int64), np.zeros(len(self.spans), bool)
        starts = [a for a, _ in self.spans]
        for kind, a, b in base:
            i = max(0, bisect_right(starts, a) - 1)
            while i < len(starts) and starts[i] < b:
                if self.spans[i][1] > a:
                    out[i], told[i] = kind + 1, True
                i += 1
        return out, told


def weights(seq: Sequence, labels: np.ndarray) -> np.ndarray:
    """How much each node counts when the field is fitted: unlabelled ones that could be what the patterns miss count little."""
    many = [len(NUMERAL.findall(w)) for _, w, _ in seq.words]
    beside = np.zeros(len(many), bool)
    for i, j in seq.chain:
        beside[[i, j]] |= many[i] >= 3 and many[j] >= 3
    may = [n >= 7 or bool(SPELLED.search(w)) or any(SIGN.fullmatch(x) for x in (before, w, after)) or b"[.]" in w or b"(.)" in w for n, (before, w, after) in zip(many, seq.words, strict=True)]
    return np.where((labels == 0) & (beside | np.array(may, bool)), DOUBT, 1.0)


class SkipChainField:
    """Weights of features by label, and one potential table each for chain and skip edges."""

    def __init__(self):
        self.unary = np.zeros((FEATURES + 1, LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = np.zeros((LABELS, LABELS))

    def fit(self, docs: list[tuple], epochs: int = EPOCHS, rate: float = 0.3, shrink: float = 1e-4, seed: int = 3) -> SkipChainField:
        """Pseudo-likelihood: each node given its neighbours' labels; AdaGrad steps. docs: (features, labels, chain, skip, and weights if there are any)."""
        docs = [d for d in docs if len(d[1])]
        sums = [np.full_like(x, 1e-6) for x in (self.unary, self.chain, self.skip)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs if docs else 0):
            for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
                features, labels, chain, skip, count, base = [], [], [], [], [], 0
                for f, y, c, s, *w in (docs[i] for i in part):
                    features.append(np.asarray(f))
                    labels.append(y)
                    count.append(w[0] if w else np.ones(len(y)))
                    chain.append(np.asarray(c, np.int64).reshape(-1, 2) + base)
                    skip.append(np.asarray(s, np.int64).reshape(-1, 2) + base)
                    base += len(y)
                x, y = np.concatenate(features), np.concatenate(labels)
                energy = self.unary[x].sum(1)
                edges = [np.concatenate(e) for e in (chain, skip)]
                for e, t in zip(edges, (self.chain, self.skip), strict=True):
                    np.add.at(energy, e[:, 1], t[y[e[:, 0]]])
                    np.add.at(energy, e[:, 0], t.T[y[e[:, 1]]])
                p = np.exp(energy - energy.max(1, keepdims=True))
                slope = p / p.sum(1, keepdims=True)
                slope[np.arange(len(y)), y] -= 1
                slope *= np.concatenate(count)[:, None] / len(part)
                grads = [np.zeros_like(self.unary), np.zeros_like(self.chain), np.zeros_like(self.skip)]
                np.add.at(grads[0], x.ravel(), np.repeat(slope, x.shape[1], 0))
                for e, g in zip(edges, grads[1:], strict=True):
                    np.add.at(g, y[e[:, 0]], slope[e[:, 1]])
                    np.add.at(g.T, y[e[:, 1]], slope[e[:, 0]])
                for w, g, s in zip((self.unary, self.chain, self.skip), grads, sums, strict=True):
                    g += shrink * w
                    s += g**2
                    w -= rate * g / np.sqrt(s)
        return self

    def beliefs(self, features: list[list[int]], chain: list, skip: list, rounds: int = ROUNDS, observed: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product: messages along all edges in both directions, `rounds` times, halfway damped. Nodes with an observed label (not 0) have it."""
        unary = self.unary[np.array(features)].sum(1)
        if observed is not None:
            seen = np.flatnonzero(observed)
            unary[seen] = -50.0
            unary[seen, observed[seen]] = 0.0
        unary -= unary.max(1, keepdims=True)
        edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        if not len(edges):
            p = np.exp(unary)
            return p / p.sum(1, keepdims=True)
        tables = np.concatenate([np.repeat(np.exp(np.clip(t, -20, 20))[None], n, 0) for t, n in ((self.chain, len(chain)), (self.skip, len(skip)))])
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        message = np.zeros((len(source), LABELS))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.maximum(np.einsum("ei,eij->ej", out, tables), 1e-300))
            message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        total = unary.copy()
        np.add.at(total, target, message)
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def plausible(kind: int, body: bytes, names: set[bytes] = frozenset()) -> bool:
    """What an added span must have at least. names: local parts that stand for an address."""
    n = len(NUMERAL.findall(body))
    signs = re.search(rb"@|[\[({<]at[\])}>]| at ", body[1:-1], re.I) is not None or body.lower() in names
    return (signs, len(RUNS.findall(body)) == 4 and all(int(x[-4:]) <= 255 for x in RUNS.findall(body)), 13 <= n <= 19 and luhn(b"".join(NUMERAL.findall(body))), 7 <= n <= 15)[kind]


def added_spans(body: bytes, base: list[tuple[int, int, int]], field: SkipChainField, belief: float = BELIEF) -> list[tuple[int, int, int]]:
    """Neighbouring nodes of one label whose belief is high, apart from the base spans, as spans."""
    seq = Sequence(body)
    if not seq.spans:
        return []
    p = field.beliefs(seq.features(), seq.chain, seq.skip, observed=seq.silver(base))
    label = np.where(p.max(1) >= belief, p.argmax(1), 0)
    cover = merged([(a, b) for _, a, b in base])
    chained, out = set(seq.chain), []
    for i, (a, b) in enumerate(seq.spans):
        k = bisect_right(cover, a)
        if not label[i] or k % 2 or k < len(cover) and cover[k] < b:
            continue
        if out and out[-1][3] == i - 1 and (i - 1, i) in chained and out[-1][0] == label[i] - 1:
            out[-1] = (out[-1][0], out[-1][1], b, i)
        else:
            out.append((int(label[i]) - 1, a, b, i))
    trimmed = []
    for kind, a, b, _ in out:
        raw = body[a:b]
        a, b = a + len(raw) - len(raw.lstrip(b".,;:!?#$%&*|<>\"'")), b - len(raw) + len(raw.rstrip(b".,;:!?#$%&*|<>\"'"))
        if b > a and plausible(kind, body[a:b], seq.names):
            trimmed.append((kind, a, b))
    return trimmed


def _render(spans: list[tuple[int, int, int]], points: dict[int, int]) -> str:
    return ",".join(f"{KINDS[k]}:{points[a]}:{points[b]}" for k, a, b in sorted(spans))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> SkipChainField:
    """A field fitted on at most sample_docs documents with a numeral or an @, the first by a hash of the id.

    It learns from each as it is, labelled by its base spans, with these spans written otherwise, and with bare later
    mentions of them and of what is like them. Texts with more than SAMPLE_NODES nodes aren't learned from.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    sample = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                out = []
                for i, t in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist(), strict=True):
                    body = t.encode("utf-8", "surrogatepass")
                    base = base_spans(body)
                    for text_, spans in [(body, base), *([perturbed(body, base), remembered(body, base)] if base else [])]:
                        seq = Sequence(text_)
                        if len(seq.spans) <= SAMPLE_NODES:
                            y, told = seq.told(spans)
                            out.append({"doc_id": i, "x": [v for f in seq.features() for v in f], "y": y.tolist(), "chain": [v for e in seq.chain for v in e], "skip": [v for e in seq.skip for v in e], "w": np.where(told, 1.0 + (y > 0), weights(seq, y)).tolist()})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("x", "y", "chain", "skip")), ("w", pa.list_(pa.float64()))]))

    table = rows.join(F.broadcast(sample), "doc_id").mapInArrow(examples, "doc_id long, x array<int>, y array<int>, chain array<int>, skip array<int>, w array<double>").toArrow()
    cells = {c: [np.asarray(v.values, t) for v in table.column(c)] for c, t in (("x", np.int32), ("y", np.int64), ("chain", np.int32), ("skip", np.int32), ("w", np.float64))}
    order = sorted(range(table.num_rows), key=lambda k: (table.column("doc_id")[k].as_py(), cells["x"][k].tobytes()))[: 3 * sample_docs]
    return SkipChainField().fit([(cells["x"][k].reshape(len(cells["y"][k]), -1), cells["y"][k], cells["chain"][k], cells["skip"][k], cells["w"][k]) for k in order if len(cells["y"][k])])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (base and added) for every row of docs.

    Whole texts are read; null counts as empty and has no spans. Rows that repeat a doc_id are rows of their own; a null
    doc_id stays null; an empty table gives an empty one; other columns aren't read. Spans are in code points, the end
    exclusive. The field learns from the base spans of a bounded sample, as they are, written otherwise (signs spelled out,
    no plus, other separators) and mentioned again. It adds tokens that look and stand like them, and, along its skip
    edges, later or earlier mentions that only the other mention tells: a number without its prefix, an address's local
    part alone. Base spans are observed labels of the field; added spans never overlap them.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, key, text, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            for step in steps(batch):
                rows = []
                for i, t in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist(), strict=True):
                    body = t.encode("utf-8", "surrogatepass")
                    base = base_spans(body)
                    added = added_spans(body, base, field)
                    at = [p for _, a, b in (*base, *added) for p in (a, b)]
                    points = dict(zip(at, code_points(t, body, at), strict=True))
                    n = [sum(k == x for k, _, _ in base) for x in range(4)]
                    rows.append((i, *n, hashlib.sha256(_render(base, points).encode()).hexdigest(), _render(base + added, points), len(added), len(base) + len(added)))
                names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")

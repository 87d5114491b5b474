"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

Blocks are independent: each starts from nothing and can be decoded alone. All arithmetic is on integers, so that any
machine decodes what another has encoded. A block is read by CURSORS cursors, each of which goes through a stretch of it
and has a range coder of its own; all cursors of a block share what the block has taught so far. A step codes one id of
every cursor of every block side by side:

* Order 2 (the two ids before, hashed) predicts the id that followed last. Order 1 (the id before) lists the ids that have
  followed it, order 0 lists all ids seen; an id has the share of a list that its number of times there gives it.
* An id is coded by order 2 if that predicts it, else by order 1 or order 0 if they list it, else as 16 bits. Which of
  these comes first; its four probabilities mix what was seen where both orders stood alike, where order 2 did, where
  order 1 did, and in the whole block.
* Predictions, lists and probabilities are taken anew when the steps done reach REFRESH, from all ids of the block so far.
"""

from __future__ import annotations

import numpy as np

#: Cursors of a block and steps of each at most (short blocks have fewer cursors), ids of a block, and blocks that are coded side by side at most.
CURSORS, STEPS = 128, 512
BLOCK, LANES = CURSORS * STEPS, 16
#: Steps after which predictions, lists and probabilities are taken anew.
REFRESH = (1, 4, 16, 64, 208)
#: Hash bits of an order-2 context and of the encoder's table of pairs; classes of a context; the least share of an outcome.
PAIR_BITS, FIND_BITS, CLASSES, LEAST = 14, 17, 8, 64
#: Ids that the encoder looks up at a time.
LOOKED_UP = 1 << 15
_TOP, _WORD = np.uint64(1 << 32), np.uint64(16)
_MASK48, _MASK16, _LOW = np.uint64((1 << 48) - 1), np.uint64(0xFFFF), np.uint32(0xFFFF)
#: Class of an order-1 context by how often it was seen: 0 for never, then 1, 2, 3 .. 4, 5 .. 8, and so on.
_CLASS = np.minimum(np.ceil(np.log2(np.maximum(np.arange(BLOCK + 1), 1))).astype(np.uint8) + 1, CLASSES - 1).astype(np.uint8)
_CLASS[0] = 0


def pair(two: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The order-2 context of two ids: PAIR_BITS bits."""
    return (two.astype(np.uint32) * np.uint32(0x9E3779B1) + before.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)


class _Memory:
    """What the ids of `blocks` blocks so far say. Rows of ids are steps, columns are cursors, block by block.

    table1 has for each block and id start << 16 | count: its stretch in the block's list of pairs (id before << 16 | id),
    in order. runs has for each pair first << 16 | count of the equal ones. The ids before, in that order, are also the
    list of order 0.
    """

    def __init__(self, blocks: int, cursors: int, steps: int):
        self.blocks, self.cursors, self.size, self.done = blocks, cursors, 0, 0
        block = np.arange(blocks * cursors) // cursors
        self.base1, self.base2, self.base_class = block << 16, block << PAIR_BITS, block * CLASSES**2
        self.table1 = np.zeros(blocks << 16, np.uint32)
        self.guess, self.sure = np.zeros(blocks << PAIR_BITS, np.uint16), np.zeros(blocks << PAIR_BITS, np.uint8)
        self.pairs = np.zeros((blocks, steps * cursors), np.uint32)
        self.keys = self.runs = np.zeros(0, np.uint32)
        self.seen = np.zeros((blocks, CLASSES, CLASSES, 4), np.int64)
        self._shares()

    def refresh(self, ids: np.ndarray) -> None:
        """ids: all so far."""
        a, b = self.done, len(ids)
        before, two = _shifted(ids, a, 1), _shifted(ids, a, 2)
        own, at = ids[a:], self.base2 + pair(two, before)
        sure = self.sure[at]
        self.sure[at] = np.where((sure > 0) & (self.guess[at] == own), np.minimum(sure + 1, CLASSES - 1), 1)
        self.guess[at] = own
        keys = (before.astype(np.uint32) << np.uint32(16)) | own
        self.pairs.reshape(self.blocks, -1, self.cursors)[:, a:b] = keys.reshape(b - a, self.blocks, self.cursors).transpose(1, 0, 2)
        self.size, self.done = b * self.cursors, b
        self._list()
        self._shares()

    def _list(self) -> None:
        size = self.size
        flat = np.sort(self.pairs[:, :size], axis=1).ravel()
        fresh = np.empty(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=fresh[1:])
        fresh[::size] = True
        self.first = np.flatnonzero(fresh)
        count = np.empty_like(self.first)
        np.subtract(self.first[1:], self.first[:-1], out=count[:-1])
        count[-1] = len(flat) - self.first[-1]
        block = self.first // size
        inside = self.first - block * size
        runs = np.repeat(((inside << 16) | count).astype(np.uint32), count)
        context = (flat[self.first] >> np.uint32(16)) + (block << 16)
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        start = self.first[head]
        self.table1[context[head]] = (inside[head] << 16) | np.diff(start, append=len(flat))
        beyond = np.zeros(1 << 16, np.uint32)  # what isn't coded by a list may point there
        self.keys, self.runs = np.concatenate([flat, beyond]), np.concatenate([runs, beyond])

    def learn(self, where: np.ndarray) -> None:
        """where: block and classes, and the outcome, of every id coded since the last time."""
        self.seen += np.bincount(where, minlength=self.seen.size).reshape(self.seen.shape)

    def _shares(self) -> None:
        """Shares of the outcomes (of 65,536), and the sums of those before, for each block and pair of classes: order 2, 1, 0, none."""
        joint = self.seen
        part = lambda x: (x << 10) // np.maximum(x.sum(-1, keepdims=True), 1)
        trust = lambda x: np.minimum(x.sum(-1, keepdims=True), 64)
        two, one, whole = joint.sum(2, keepdims=True), joint.sum(1, keepdims=True), joint.sum((1, 2), keepdims=True)
        mixed = (joint << 10) + part(two) * trust(two) // 8 + part(one) * trust(one) // 8 + 2 * part(whole) + 256
        mixed[:, 0, :, 0] = 0
        mixed[:, :, 0, 1] = 0
        if not self.size:
            mixed[..., 2] = 0
        able = mixed > 0
        share = mixed * (65536 - LEAST * able.sum(-1, keepdims=True)) // mixed.sum(-1, keepdims=True) + LEAST * able
        best = share.argmax(-1)[..., None]
        np.put_along_axis(share, best, np.take_along_axis(share, best, -1) + 65536 - share.sum(-1, keepdims=True), -1)
        start = np.cumsum(share, -1) - share
        self.start, self.share = start.ravel().astype(np.uint64), share.ravel().astype(np.uint64)
        self.bounds = tuple(start[..., k].ravel().astype(np.uint64) for k in (1, 2, 3))


def _shifted(ids: np.ndarray, start: int, by: int) -> np.ndarray:
    """Row i is row start + i - by of ids, or zeros before the first one."""
    out = np.zeros((len(ids) - start, ids.shape[1]), ids.dtype)
    a = max(0, by - start)
    out[a:] = ids[start + a - by : len(ids) - by]
    return out


def _shape(size: int) -> tuple[int, int]:
    """Cursors and steps for a block of so many ids."""
    cursors = min(CURSORS, max(1, -(-size // STEPS)))
    return cursors, -(-size // cursors)


def split(ids: np.ndarray) -> list[np.ndarray]:
    """The ids in blocks of about equal size, as long as BLOCK allows; only the last is shorter than the others."""
    cursors, steps = _shape(-(-len(ids) // max(1, -(-len(ids) // BLOCK))))
    return [ids[k : k + cursors * steps] for k in range(0, len(ids), max(cursors * steps, 1))]


def _alive(sizes: list[int], cursors: int, steps: int) -> tuple[int, int]:
    """Cursors that have ids in every step, and the steps that one cursor more has; blocks but the last are full."""
    whole, rest = divmod(sizes[-1], steps)
    return (len(sizes) - 1) * cursors + whole, rest


def _levels(steps: int):
    """Stretches of steps between refreshes."""
    marks = [0, *(t for t in REFRESH if t < steps), steps]
    return list(zip(marks[:-1], marks[1:], strict=True))


def _coded(where: np.ndarray, start: int, full: int, rest: int) -> np.ndarray:
    """The part of the rows from step `start` on that cursors with ids have."""
    more = max(0, min(start + len(where), rest) - start)
    return np.concatenate([where[:more, : full + 1].ravel(), where[more:, :full].ravel()])


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 65,536, at most BLOCK of them) as bytes."""
    out: list[bytes] = []
    start = 0
    for k in range(1, len(blocks) + 1):
        # blocks of one size, full in every step, go side by side, and a shorter one after them
        full, (cursors, steps) = len(blocks[k - 1]), _shape(len(blocks[start]))
        if k == len(blocks) or k - start == LANES or full != cursors * steps or len(blocks[k]) > full:
            out += _encode(blocks[start:k])
            start = k
    return out


class _Finder:
    """Where the lists have a pair, by a hash table whose slots the last pair gets; a pair that isn't found counts as not listed."""

    def __init__(self, memory: _Memory):
        self.memory, self.table = memory, np.full(memory.blocks << FIND_BITS, -1, np.int32)
        self.base = (memory.base1 >> 16) << FIND_BITS

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - FIND_BITS)

    def refresh(self) -> None:
        first = self.memory.first
        self.table[((first // self.memory.size) << FIND_BITS) + self._slot(self.memory.keys[first])] = first

    def parts(self, own: np.ndarray, before: np.ndarray, two: np.ndarray):
        """For ids after those before: the classes, the outcome, and the part of the list: (first, count, all)."""
        m = self.memory
        e1, at2 = m.table1[m.base1 + before], m.base2 + pair(two, before)
        sure = m.sure[at2]
        where = m.base_class + (sure * np.uint8(CLASSES) + _CLASS[e1 & _LOW])
        where *= 4
        outcome = np.full(own.shape, 3, np.uint8)
        first, count, total = own.astype(np.uint64), np.ones(own.shape, np.uint64), np.full(own.shape, 1 << 16, np.uint64)
        if m.size:
            key = before.astype(np.uint32)
            key <<= np.uint32(16)
            key |= own
            at = self.table[self.base + self._slot(key)]
            hit = (sure > 0) & (m.guess[at2] == own)
            listed = (m.keys[at] == key) & (at >= 0) & ~hit
            k = np.flatnonzero(listed)
            run, e = m.runs[at.ravel()[k]], e1.ravel()[k]
            outcome.ravel()[k] = 1
            first.ravel()[k] = (run >> np.uint32(16)) - (e >> np.uint32(16))
            count.ravel()[k], total.ravel()[k] = run & _LOW, e & _LOW
            k = np.flatnonzero(~(listed | hit))
            run = m.table1[(m.base1 + own).ravel()[k]]
            k, run = k[run > 0], run[run > 0]
            outcome.ravel()[k] = 2
            first.ravel()[k], count.ravel()[k], total.ravel()[k] = run >> np.uint32(16), run & _LOW, m.size
            k = np.flatnonzero(hit)
            outcome.ravel()[k], first.ravel()[k], total.ravel()[k] = 0, 0, 1
        where += outcome
        return where, first, count, total


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes, nb = [len(b) for b in blocks], len(blocks)
    cursors, steps = _shape(sizes[0])
    if not steps:
        return [b""] * nb
    lanes = nb * cursors
    full, rest = _alive(sizes, cursors, steps)
    padded = np.zeros(lanes * steps, np.uint16)
    for k, b in enumerate(blocks):
        padded[k * cursors * steps : k * cursors * steps + len(b)] = b
    ids = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    memory = _Memory(nb, cursors, steps)
    finder = _Finder(memory)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    cap = steps * 3 + 16
    words, used = np.zeros(lanes * cap, np.uint16), np.arange(lanes, dtype=np.int64) * cap + 1

    def carry(at: np.ndarray) -> None:
        """Adds 1 to the words, and to those before while they overflow."""
        while len(at):
            words[at] += 1
            at = at[words[at] == 0] - 1

    for a, b in _levels(steps):
        if a:
            memory.refresh(ids[:a])
            finder.refresh()
        some = max(1, LOOKED_UP // lanes)
        for c in range(a, b, some):
            d = min(b, c + some)
            where, first, count, total = finder.parts(ids[c:d], _shifted(ids[:d], c, 1), _shifted(ids[:d], c, 2))
            start, share = memory.start[where], memory.share[where]
            for t in range(c, d):
                n, k = full + (t < rest), t - c
                r = wide[:n] >> _WORD
                now = low[:n]
                now += r * start[k, :n]
                r *= share[k, :n]
                r //= total[k, :n]
                now += r * first[k, :n]
                np.multiply(r, count[k, :n], out=wide[:n])
                # narrow ranges put out a word; a carry goes to the word before: ranges are nested, so there is one at most
                thin = np.flatnonzero(wide[:n] < _TOP)
                while len(thin):
                    own, at = low[thin], used[thin]
                    over = own > _MASK48
                    if over.any():
                        carry(at[over] - 1)
                    words[at] = (own >> np.uint64(32)).astype(np.uint16)
                    used[thin] = at + 1
                    low[thin] = (own << _WORD) & _MASK48
                    narrow = wide[thin] << _WORD
                    wide[thin] = narrow
                    thin = thin[narrow < _TOP]
            memory.learn(_coded(where, c, full, rest))
    carry(used[low > _MASK48] - 1)
    for shift in (32, 16, 0):
        words[used] = ((low >> np.uint64(shift)) & _MASK16).astype(np.uint16)
        used += 1
    lengths = (used - np.arange(lanes, dtype=np.int64) * cap - 1).reshape(nb, cursors)
    table = words.reshape(nb, cursors, cap)[:, :, 1:]
    place = np.arange(cap - 1)
    return [np.concatenate([[steps, cursors], lengths[k], table[k][place < lengths[k][:, None]]]).astype("<u2").tobytes() if sizes[k] else b"" for k in range(nb)]


def decode(parts: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks that encode() made the parts of."""
    shapes = [tuple(np.frombuffer(p, "<u2", 2).tolist()) if p else (0, 0) for p in parts]
    out: list[np.ndarray] = []
    start = 0
    for k in range(1, len(parts) + 1):
        if k == len(parts) or k - start == LANES or sizes[k - 1] != shapes[k - 1][0] * shapes[k - 1][1] or shapes[k] != shapes[k - 1] or not sizes[k]:
            out += _decode(parts[start:k], sizes[start:k])
            start = k
    return out


#: By outcome: by how much a key is shifted to give the id.
_SHIFT = np.array([0, 0, 16, 0], np.uint32)


def _decode(parts: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    nb = len(parts)
    if not sizes[0]:
        return [np.zeros(0, np.uint16)] * nb
    found = [np.frombuffer(p, "<u2") for p in parts]
    steps, cursors = found[0][:2].tolist()
    lanes = nb * cursors
    full, rest = _alive(sizes, cursors, steps)
    lengths = np.concatenate([f[2 : 2 + cursors] for f in found]).astype(np.int64)
    words = np.concatenate([*(f[2 + cursors :] for f in found), np.zeros(8, np.uint16)])
    used = np.cumsum(lengths) - lengths
    value = (words[used].astype(np.uint64) << np.uint64(32)) | (words[used + 1].astype(np.uint64) << _WORD) | words[used + 2]
    used += 3
    wide = np.full(lanes, 1 << 48, np.uint64)
    ids = np.zeros((steps, lanes), np.uint16)
    memory = _Memory(nb, cursors, steps)
    block = np.arange(lanes, dtype=np.int64) // cursors
    none = np.zeros(lanes, np.uint16)
    for a, b in _levels(steps):
        if a:
            memory.refresh(ids[:a])
        size, place = memory.size, block * memory.size
        m1, m2, m3 = memory.bounds
        amount = np.array([1, 1, size, 1 << 16], np.uint64)
        met = np.zeros((b - a, lanes), np.int64)
        e1 = memory.table1[memory.base1 + (ids[a - 1] if a else 0)]
        for t in range(a, b):
            n = full + (t < rest)
            e1 = e1[:n]
            at2 = memory.base2[:n] + pair(ids[t - 2, :n] if t > 1 else none[:n], ids[t - 1, :n] if t else none[:n])
            n1 = e1 & _LOW
            where = memory.base_class[:n] + (memory.sure[at2] * np.uint8(CLASSES) + _CLASS[n1])
            r = wide[:n] >> _WORD
            v = value[:n] // r
            outcome = (v >= m1[where]).view(np.uint8) + (v >= m2[where]).view(np.uint8) + (v >= m3[where]).view(np.uint8)
            where *= 4
            where += outcome
            met[t - a, :n] = where
            now = value[:n] - r * memory.start[where]
            r *= memory.share[where]
            ruled = outcome == 1
            total = np.where(ruled, n1, amount[outcome])
            r //= total
            slot = (now // r).view(np.int64)
            guessed, alone = np.flatnonzero(outcome == 0), np.flatnonzero(outcome == 3)
            if size:
                stretch = (e1 >> np.uint32(16)) * ruled
                spot = place[:n] + slot
                spot += stretch
                found = (memory.keys[spot] >> _SHIFT[outcome]) & _LOW
                found[guessed] = memory.guess[at2[guessed]]
                found[alone] = slot[alone]
                e1 = memory.table1[memory.base1[:n] + found]
                run = np.where(ruled, memory.runs[spot], e1)
                first, count = ((run >> np.uint32(16)) - stretch).astype(np.uint64), (run & _LOW).astype(np.uint64)
                first[guessed], count[guessed] = 0, 1
                first[alone], count[alone] = slot[alone], 1
                ids[t, :n] = found
                value[:n] = now - r * first
                np.multiply(r, count, out=wide[:n])
            else:
                ids[t, :n] = slot
                value[:n] = now - r * slot.view(np.uint64)
                wide[:n] = r
            thin = np.flatnonzero(wide[:n] < _TOP)
            while len(thin):
                at = used[thin]
                value[thin] = (value[thin] << _WORD) | words[at]
                used[thin] = at + 1
                narrow = wide[thin] << _WORD
                wide[thin] = narrow
                thin = thin[narrow < _TOP]
        memory.learn(_coded(met, a, full, rest))
    rows = np.ascontiguousarray(ids.T).reshape(nb, -1)
    return [rows[k, : sizes[k]].copy() for k in range(nb)]

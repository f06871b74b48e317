"""A range coder for token ids that mixes order-0 to order-2 predictions, over many blocks at once.

Every block is coded on its own: fresh tables, fresh coder, a checksum of its ids. The blocks of a batch go
through the same numpy operations side by side, one id of each block per step.

Model of an id x, given the two before it (c1, c2), all adaptive inside the block:

* order 2 and order 1: a hashed context keeps the id last seen there and a confidence (0 to 3). How often
  that id is right is learnt for each confidence.
* order 0: counts of log-spaced ranges of ids; even inside a range.

    P(x) = w2 [x = p2] + w1 [x = p1] + w0 P0(x)

with w2 the learnt chance of p2, w1 that of p1 in what is left, w0 the rest; if p1 = p2 their shares add up.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Ids per block, sizes of the context tables, steps between updates of the order-0 shares.
BLOCK, TABLE1, TABLE2, REFRESH = 2048, 512, 1024, 128
#: The coder's register has four 16-bit words; a range of FLOOR or more needs no new word.
FLOOR, WORD = np.uint64(1 << 48), 0xFFFF
#: Chances of the three parts of the mixture add up to SCALE, each id's share of the range to its square.
SCALE = 1 << 16
#: Least chance of order 0: enough for one unit of the finest share.
LEAST0 = 4096

_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
MAGIC = b"TIDB"
#: magic, ids, bytes of the payload, checksum of the ids, checksum of what stands before and of the payload
HEADER = struct.Struct("<4sIIII")


def _ranges() -> tuple[np.ndarray, np.ndarray]:
    """First id and width of each range: single ids below 16, then eight ranges to every power of two."""
    first = [*range(16)]
    for power in range(4, 18):
        first += [(1 << power) + k * (1 << power) // 8 for k in range(8)]
    edges = np.array([*first, 1 << 18], np.int64)
    return edges[:-1], np.diff(edges)


FIRST, WIDTH = _ranges()
RANGES = len(FIRST)
MOST_ID = 1 << 18
_RANGE_OF = np.repeat(np.arange(RANGES), WIDTH)
#: Widths are powers of two: their exponents, and the last place inside a range.
_SHIFT, _LAST = np.log2(WIDTH).astype(np.uint32), (WIDTH - 1).astype(np.uint32)
_FIRST = FIRST.astype(np.uint32)
#: Edges that the decoder compares before it halves the ranges between two of them.
COARSE = 16
_U0, _U16, _SCALE = np.uint32(0), np.uint32(16), np.uint32(SCALE)
_HASH1, _HASH2, _HASH3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x27D4EB2F)
_DROP, _SLOTS = np.array([[13], [16]], np.uint32), np.array([[TABLE1 - 1], [TABLE2 - 1]], np.uint32)


class _Model:
    """Tables of ``n`` blocks; every method works on the first ``k`` of them.

    Numbers of the mixture fit 32 bits without a sign: what multiplies is at most SCALE, and all parts add up to its square.
    """

    def __init__(self, n: int):
        # Both orders stand in one array: order 1 of all blocks, then order 2.
        self.table = np.zeros(n * (TABLE1 + TABLE2), np.int32)
        self.all_slots = np.stack([np.arange(n) * TABLE1, n * TABLE1 + np.arange(n) * TABLE2])
        self.shares = np.repeat(np.array([SCALE // 16, SCALE // 8], np.int32), 4 * n)
        self.all_sure = np.stack([np.arange(n) * 4, 4 * n + np.arange(n) * 4])
        # A row of counts, chances and sums has one place more than there are ranges.
        self.all_rows = np.arange(n) * (RANGES + 1)
        self.counts = np.full((n, RANGES + 1), 4, np.int32)
        self.cum, self.freq = np.zeros((n, RANGES + 1), np.uint32), np.zeros((n, RANGES + 1), np.uint32)
        self.flat_counts, self.flat_cum, self.flat_freq = self.counts.reshape(-1), self.cum.reshape(-1), self.freq.reshape(-1)
        self.coarse = np.zeros((RANGES // COARSE - 1, n), np.uint32)
        self.before = np.zeros(n, np.uint32)
        self.lanes(n)
        self.refresh(n)

    def lanes(self, k: int) -> None:
        self.slots, self.sure_at, self.rows = self.all_slots[:, :k], self.all_sure[:, :k], self.all_rows[:k]
        self.before, self.edges = self.before[:k], self.coarse[:, :k]

    def refresh(self, k: int) -> None:
        sums = self.counts[:k, :RANGES].cumsum(1, dtype=np.int64)
        self.cum[:k, 1:] = np.arange(1, RANGES + 1) + sums * (SCALE - RANGES) // sums[:, -1:]
        np.subtract(self.cum[:k, 1:], self.cum[:k, :-1], out=self.freq[:k, :-1])
        self.coarse[:, :k] = self.cum[:k, COARSE:RANGES:COARSE].T

    def predict(self, c1: np.ndarray) -> None:
        """Predictions after the ids ``c1`` (and those of the call before)."""
        slot = np.empty((2, len(c1)), np.uint32)
        np.multiply(c1, _HASH1, out=slot[0])
        np.multiply(c1, _HASH2, out=slot[1])
        slot[1] += self.before
        slot >>= _DROP
        slot &= _SLOTS
        self.before = c1 * _HASH3
        self.j = slot + self.slots
        self.entry = self.table.take(self.j)
        self.sure = self.entry & 3
        self.kept = self.entry >> 2
        self.p1, self.p2 = self.kept
        self.k = self.sure + self.sure_at
        self.chance = self.shares.take(self.k)
        r1, r2 = self.chance.view(np.uint32)
        w2 = r2 * np.uint32(SCALE - LEAST0 - 256)
        w2 >>= _U16
        w2 += np.uint32(64)
        w1 = np.uint32(SCALE - LEAST0 - 128) - w2
        w1 *= r1
        w1 >>= _U16
        w1 += np.uint32(64)
        both = w1 + w2
        self.left = _SCALE - both
        # Ends of the parts of order 2 and 1; one id predicted twice has both.
        self.end2 = np.where(self.p1 == self.p2, both, w2)
        self.end2 <<= _U16
        self.end1 = both
        self.end1 <<= _U16

    def update(self, hit: np.ndarray, x4: np.ndarray, row: np.ndarray) -> None:
        """Learn ids (``x4``: four times the id) whose counts stand at ``row``; ``hit``: where order 1 and 2 were right."""
        learnt = np.where(self.sure > 0, self.entry - 1, x4)
        self.table[self.j] = np.where(hit, self.entry + (self.sure < 3), learnt)
        step = hit * np.int32(SCALE - 1)
        step -= self.chance
        step >>= 5
        step += self.chance
        self.shares[self.k] = step
        self.flat_counts[row] += 32


def _check(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _ks(lengths: np.ndarray, steps: int) -> list[int]:
    """For each step the number of blocks (longest first) that have an id there."""
    return np.searchsorted(-lengths, -np.arange(steps), "left").tolist()


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Each block (ids below 2**18, at least one) as header and payload."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    n, steps = len(order), int(lengths[0]) if len(order) else 0
    ids = np.zeros((steps, n), np.int32)
    for column, i in enumerate(order):
        ids[:len(blocks[i]), column] = blocks[i]
    if n and (ids.max() >= MOST_ID or ids.min() < 0):
        raise ValueError("ids must be from 0 to 2**18 - 1")
    model = _Model(n)
    low, span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
    width = 2 * steps + 8  # a share of one unit takes two words
    words, at = np.zeros((n, width), np.uint32), np.arange(n) * width
    flat, begin = words.reshape(-1), np.arange(n) * width
    c1, had = np.zeros(n, np.uint32), n
    for t, k in enumerate(_ks(lengths, steps)):
        if k != had:
            had, c1 = k, c1[:k]
            model.lanes(k)
        model.predict(c1)
        x = ids[t, :k]
        place = _RANGE_OF.take(x)
        c1 = x.view(np.uint32)
        two, one = (hit := model.kept == x)[::-1]
        row = model.rows + place
        left, end2, end1 = model.left, model.end2, model.end1
        share = left * model.flat_freq.take(row)
        share >>= _SHIFT.take(place)
        start = left * model.flat_cum.take(row)
        start += end1
        start += share * (c1 - _FIRST.take(place))
        # A prediction that is right takes its own part; order 2 comes first.
        start = np.where(two, _U0, np.where(one, end2, start))
        share = np.where(two, end2, np.where(one, end1 - end2, share))
        r = span[:k] >> _32
        more = start.astype(np.uint64)
        more *= r
        low_k, span_k = low[:k], span[:k]
        low_k += more
        np.multiply(r, share.astype(np.uint64), out=span_k)
        # A carry goes to the word before; it is passed on when all is written.
        if len(over := np.flatnonzero(low_k < more)):
            flat[at[over] - 1] += 1
        # Every block writes its next word, and goes on to the one after if its range asks for it.
        need, at_k = span_k < FLOOR, at[:k]
        flat[at_k] = low_k >> _48
        at_k += need
        bits = need * _16
        low_k <<= bits
        span_k <<= bits
        small = np.flatnonzero(span_k < FLOOR)
        while len(small):
            flat[at[small]] = low[small] >> _48
            at[small] += 1
            low[small] <<= _16
            span[small] <<= _16
            small = small[span[small] < FLOOR]
        model.update(hit, x << 2, row)
        if t % REFRESH == REFRESH - 1:
            model.refresh(k)
    for shift in (48, 32, 16, 0):
        flat[at] = low >> np.uint64(shift) & np.uint64(WORD)
        at += 1
    used = at - begin
    for column in range(int(used.max()) - 1 if n else 0, 0, -1):
        words[:, column - 1] += words[:, column] >> 16
        words[:, column] &= WORD
    out: list[bytes] = [b""] * n
    for column, i in enumerate(order):
        payload = words[column, :used[column]].astype("<u2").tobytes()
        head = HEADER.pack(MAGIC, len(blocks[i]), len(payload), _check(blocks[i]), 0)[:-4]
        out[i] = head + struct.pack("<I", zlib.crc32(payload, zlib.crc32(head))) + payload
    return out


def decode_blocks(data: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block; a ValueError if a checksum fails."""
    heads = [HEADER.unpack_from(d) for d in data]
    for d, (magic, _, size, _, check) in zip(data, heads, strict=True):
        payload = d[HEADER.size:HEADER.size + size]
        if magic != MAGIC or len(payload) != size or zlib.crc32(payload, zlib.crc32(d[:HEADER.size - 4])) != check:
            raise ValueError("damaged block")
    order = sorted(range(len(data)), key=lambda i: -heads[i][1])
    lengths = np.array([heads[i][1] for i in order])
    n, steps = len(order), int(lengths[0]) if len(order) else 0
    width = max((heads[i][2] // 2 for i in order), default=0) + 4
    words = np.zeros((n, width), np.uint16)
    for column, i in enumerate(order):
        size = heads[i][2]
        words[column, :size // 2] = np.frombuffer(data[i], "<u2", size // 2, HEADER.size)
    flat, at = words.reshape(-1), np.arange(n) * width + 4
    first = words[:, :4].astype(np.uint64)
    code = first[:, 0] << _48 | first[:, 1] << _32 | first[:, 2] << _16 | first[:, 3]
    span = np.full(n, 2**64 - 1, np.uint64)
    model, ids = _Model(n), np.zeros((steps, n), np.int32)
    c1, had = np.zeros(n, np.uint32), n
    for t, k in enumerate(_ks(lengths, steps)):
        if k != had:
            had, c1 = k, c1[:k]
            model.lanes(k)
        model.predict(c1)
        left, end2, end1 = model.left, model.end2, model.end1
        code_k, span_k, at_k = code[:k], span[:k], at[:k]
        r = span_k >> _32
        value = np.minimum(code_k // r, np.uint64(2**32 - 1)).astype(np.uint32)
        two, rest = value < end2, value >= end1
        # Where a prediction is right, what order 0 gives here is not used.
        target = (value - end1) // left
        row = (model.edges <= target).sum(0, dtype=np.uint8) * np.int64(COARSE)
        row += model.rows
        step = COARSE // 2
        while step:
            row += (model.flat_cum.take(row + step) <= target) * np.int64(step)
            step //= 2
        place = row - model.rows
        share = left * model.flat_freq.take(row)
        share >>= _SHIFT.take(place)
        start = left * model.flat_cum.take(row)
        start += end1
        offset = np.minimum((value - start) // share, _LAST.take(place))
        start += share * offset
        offset += _FIRST.take(place)
        x = np.where(rest, offset.view(np.int32), np.where(two, model.p2, model.p1))
        start = np.where(rest, start, np.where(two, _U0, end2)).astype(np.uint64)
        share = np.where(rest, share, np.where(two, end2, end1 - end2)).astype(np.uint64)
        start *= r
        code_k -= start
        np.multiply(r, share, out=span_k)
        need = span_k < FLOOR
        bits = need * _16
        code_k <<= bits
        code_k |= flat.take(at_k) * need
        span_k <<= bits
        at_k += need
        small = np.flatnonzero(span_k < FLOOR)
        while len(small):
            code[small] = code[small] << _16 | flat[at[small]]
            at[small] += 1
            span[small] <<= _16
            small = small[span[small] < FLOOR]
        ids[t, :k] = x
        c1 = x.view(np.uint32)
        model.update(model.kept == x, x << 2, model.rows + _RANGE_OF.take(x))
        if t % REFRESH == REFRESH - 1:
            model.refresh(k)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for column, i in enumerate(order):
        out[i] = ids[:heads[i][1], column].astype(np.int64)
        if _check(out[i]) != heads[i][3]:
            raise ValueError("ids do not fit their checksum")
    return out

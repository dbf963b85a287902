"""Elias-Fano coded monotone sequences in plain arrays, with vectorised access and search.

A value is cut into ``low`` bits, stored side by side, and a high part,
stored in unary in ``upper``: the bit at (high part + position) is set.  The
two directories count ones and zeros up to each 64-bit word.  All arrays may
be memory-mapped; queries touch only the words they need.
"""

from __future__ import annotations

import numpy as np

PARTS = ("shape", "low", "upper", "ones", "zeros")
RUN = 1 << 15  # queries answered at once, so that what they need stays in the processor's cache
_PAIRS, _FOURS, _BYTES = 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F
_ONES, _TOPS = 0x0101010101010101, 0x8080808080808080
#: Place of the r-th set bit (from 0) of a byte, at 8 * byte + r.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a non-decreasing sequence of non-negative integers."""
    v = np.asarray(values, np.int64)
    n = len(v)
    top = int(v[-1]) if n else 0
    bits = max(0, int(np.floor(np.log2((top + 1) / n)))) if n else 0
    high = v >> bits
    flags = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    upper = np.packbits(flags, bitorder="little").view("<u8")
    ones = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    rest = v & ((1 << bits) - 1)
    low = np.zeros(-(-n * bits // 8) + 8, np.uint8)
    run = 8 * 65536  # whole bytes of every run of values
    for at in range(0, n if bits else 0, run):
        part = (rest[at:at + run, None] >> np.arange(bits)).astype(np.uint8) & 1
        packed = np.packbits(part.ravel(), bitorder="little")
        low[at * bits // 8:at * bits // 8 + len(packed)] = packed
    zeros = 64 * np.arange(1, len(upper) + 1, dtype=np.int64) - ones
    return {"shape": np.array([n, bits, int(high[-1]) if n else -1], np.int64), "low": low, "upper": upper,
            "ones": ones.astype(np.uint32 if n < 1 << 31 else np.uint64),
            "zeros": zeros.astype(np.uint32 if len(flags) < 1 << 31 else np.uint64)}


def _select(words: np.ndarray, upto: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th set bit (from 0), or of the k-th clear bit."""
    at = np.searchsorted(upto, k.astype(upto.dtype), side="right")
    x = words[at]
    if flip:
        x = ~x
    r = (k - upto[at].astype(np.int64) + np.bitwise_count(x)).astype(np.uint64)
    # Byte i of ``sums`` counts the set bits of the bytes up to i; the bytes whose sum is at most r come before.
    sums = x - ((x >> 1) & _PAIRS)
    sums = (sums & _FOURS) + ((sums >> 2) & _FOURS)
    sums = ((sums + (sums >> 4)) & _BYTES) * _ONES
    skip = np.bitwise_count(((r * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) << 3
    r -= ((sums << 8) >> skip) & 255
    byte = (x >> skip) & 255
    return at.astype(np.int64) * 64 + skip.astype(np.int64) + _IN_BYTE[(byte << 3 | r).astype(np.int64)]


def _after(words: np.ndarray, upto: np.ndarray, place: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Place of the k-th set (or clear) bit, from the place of the one before it (-1: none is)."""
    x = words[place >> 6]
    if flip:
        x = ~x
    x = x >> (place & 63).astype(np.uint64) >> 1
    out = place + 1 + np.bitwise_count((x & (~x + 1)) - 1)
    far = np.flatnonzero((x == 0) | (place < 0))
    out[far] = _select(words, upto, k[far], flip)
    return out


class Sequence:
    """Queries on the arrays of `encode`."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits, self.top = (int(x) for x in parts["shape"])
        self.upper, self.ones, self.zeros = parts["upper"], parts["ones"], parts["zeros"]
        low = parts["low"]
        self.low = np.lib.stride_tricks.as_strided(low.view(np.uint8)[:8].view("<u8"), (len(low) - 7,), (1,), writeable=False)
        self.mask = np.uint64((1 << self.bits) - 1)

    def low_at(self, j: np.ndarray) -> np.ndarray:
        bit = j * self.bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def access(self, j: np.ndarray) -> np.ndarray:
        """The values at the places j (each below n)."""
        high = _select(self.upper, self.ones, j, False) - j
        return (high << self.bits) | self.low_at(j).astype(np.int64)

    def access_two(self, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the places j and j + 1."""
        one = _select(self.upper, self.ones, j, False)
        two = _after(self.upper, self.ones, one, j + 1, False)
        return (((one - j) << self.bits) | self.low_at(j).astype(np.int64),
                ((two - j - 1) << self.bits) | self.low_at(j + 1).astype(np.int64))

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each x in [lo, hi), or -1: the run of its high part by select, then its low bits by halving."""
        out = np.full(len(x), -1, np.int64)
        high = x >> self.bits
        ask = np.flatnonzero((high <= self.top) & (lo < hi) & (x >= 0))
        if not len(ask):
            return out
        h, want = high[ask], (x[ask] & ((1 << self.bits) - 1)).astype(np.uint64)
        gap = np.full(len(ask), -1, np.int64)  # the clear bits before and after the run
        some = np.flatnonzero(h > 0)
        gap[some] = _select(self.upper, self.zeros, h[some] - 1, True)
        start = gap - (h - 1)
        end = _after(self.upper, self.zeros, gap, h, True) - h
        a, b = np.maximum(start, lo[ask]), np.minimum(end, hi[ask])
        last = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            below = self.low_at(mid) < want[live]
            a[live] = np.where(below, mid + 1, a[live])
            b[live] = np.where(below, b[live], mid)
            live = live[a[live] < b[live]]
        hit = np.flatnonzero(a < last)
        hit = hit[self.low_at(a[hit]) == want[hit]]
        out[ask[hit]] = a[hit]
        return out


def encode_level(node: np.ndarray, value: np.ndarray, nodes: int) -> dict[str, np.ndarray]:
    """Successor lists of ``nodes`` nodes: (node, value) pairs in order, values rising within a node.

    ``ptr`` holds where each list begins.  ``val`` continues each list from
    the last value of the one before, so that the whole is one rising sequence.
    """
    ptr = np.searchsorted(node, np.arange(nodes + 1))
    span = np.zeros(nodes + 1, np.int64)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    span[full + 1] = value[ptr[full + 1] - 1] + 1
    base = np.cumsum(span)
    out = {f"ptr.{k}": v for k, v in encode(ptr).items()}
    return out | {f"val.{k}": v for k, v in encode(value + 1 + base[node]).items()}


class Level:
    """Context-relative search in the lists of `encode_level`."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ptr = Sequence({k: arrays[f"ptr.{k}"] for k in PARTS})
        self.val = Sequence({k: arrays[f"val.{k}"] for k in PARTS})

    def search(self, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the value in the whole level or -1, place in its node's list)."""
        at, lo = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
        for k in range(0, len(node), RUN):
            at[k:k + RUN], lo[k:k + RUN] = self._search(node[k:k + RUN], value[k:k + RUN])
        return at, at - lo

    def _search(self, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.ptr.access_two(node)
        base = np.zeros(len(node), np.int64)
        later = np.flatnonzero((lo > 0) & (lo < hi))
        base[later] = self.val.access(lo[later] - 1)
        return self.val.find(value + 1 + base, lo, hi), lo

"""Hashed word shingles of whole texts, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of the position-weighted byte sums and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 500_000
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a byte buffer; words lie between the six ASCII spaces."""
    inside = ~_IS_SPACE[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:len(raw)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_arrays(texts: list[bytes], words: int):
    """Yield (number of texts, shingle hashes, shingles per text) for runs of consecutive texts.

    A text of fewer words gives its whole sequence as one shingle, a text
    without words none.  Repeated shingles are still there.
    """
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < SLICE_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        raw = np.frombuffer(b"\n".join(texts[at:stop]) + b"\n", np.uint8)
        first = np.cumsum([0, *(len(t) + 1 for t in texts[at:stop])])
        h, start = word_hashes(raw)
        bounds = np.searchsorted(start, first)  # words before each text
        n_words = np.diff(bounds)
        n_sh = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
        m = len(h)
        rolled = np.zeros(m, np.uint64)
        left = np.repeat(bounds[1:], n_words) - np.arange(m)  # words from here to the end of the text
        for k in range(words):
            step = U((BASE * (2 * k + 3) ** 5 | 1) % (1 << 64))
            part = h[k:] * step
            rolled[:m - k] += np.where(left[:m - k] > k, part, U(0)) if k else part
        span = np.minimum(np.repeat(n_words, n_words), words).astype(np.uint64)
        rolled = mix(rolled + span)
        place = np.arange(m) - np.repeat(bounds[:-1], n_words)
        yield stop - at, rolled[place < np.repeat(n_sh, n_words)], n_sh
        at = stop


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for _, h, n in shingle_arrays(texts, words):
        ends = np.cumsum(n)
        out += [np.unique(h[e - k:e]) for e, k in zip(ends, n, strict=True)]
    return out

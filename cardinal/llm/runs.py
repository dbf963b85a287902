"""Operator 13: periodic runs of words, found through a grammar.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length >= max(24, 3 q) that no neighbouring word extends.

1. The words of a bounded batch of texts become ids (exact, by a dictionary).
   Re-Pair in rounds: every adjacent pair that occurs twice, and more often
   than the pairs it overlaps, is replaced by a nonterminal everywhere at once.
   What is left of each text is paired up level by level, so that the grammar
   of a text has one root.  Nonterminals are shared by all texts of a batch.
2. A run lies in the smallest nonterminal around it across the boundary of its
   two parts, and at least half of it lies on one side.  So for each
   nonterminal, once, the distances at which four words next to its boundary
   return are tested as periods, and those that hold are extended both ways
   inside the nonterminal.  Equality of stretches is tested on 62-bit prefix
   hashes, for all nonterminals at once.
3. The intervals are carried to every place where the nonterminal was put, and
   intervals of one period that overlap by a period are merged.  Each merged
   run is then checked word by word: its period and that it is maximal.

Cases: null and empty texts have no words and no run; texts of any length are
taken whole; a null id is an id like any other for the detection (and is never
planted); repeated rows each give a row; no rows give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import arrow_map

MIN_WORDS, MIN_PERIODS, GRAM = 24, 3, 4
SLICE_BYTES = 2_000_000
CANDIDATES = 1 << 20  # tested at a time
PRIMES = (np.int64(2147483647), np.int64(2147483629))


class StretchHashes:
    """Prefix sums of ids * base**i modulo two primes: equality of stretches in constant time."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.parts = []
        for p in PRIMES:
            base = rng.integers(1 << 20, p - 1)
            power = np.ones(len(ids) + 1, np.int64)
            done = 1
            step = base
            while done < len(power):
                power[done:2 * done] = power[:min(done, len(power) - done)] * step % p
                done, step = 2 * done, step * step % p
            words = rng.integers(1, p, int(ids.max(initial=0)) + 1)
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(words[ids] * power[:-1] % p) % p))
            self.parts.append((p, power, total))

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """True where ids[i:i+n] equals ids[j:j+n]; needs i <= j."""
        out = np.ones(len(i), bool)
        for p, power, total in self.parts:
            left = (total[i + n] - total[i]) % p * power[j - i] % p
            out &= left == (total[j + n] - total[j]) % p
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from i and from j (i <= j), at most ``most``."""
        return self._longest(lambda n: self.same(i, j, n), most)

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same before i and before j."""
        return self._longest(lambda n: self.same(i - n, j - n, n), most)

    @staticmethod
    def _longest(holds, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def small_factors(most: int) -> np.ndarray:
    """The smallest prime factor of every number up to ``most``."""
    out = np.zeros(most + 1, np.int64)
    for f in range(2, int(most**0.5) + 1):
        if not out[f]:
            rest = out[f * f::f]
            rest[rest == 0] = f
    plain = out == 0
    out[plain] = np.arange(most + 1)[plain]
    return out


class Grammar:
    """Nonterminals of MIN_WORDS words or more: ``left``, ``cut`` and ``right`` are one stretch of the ids and the
    boundary in it, ``places`` all starts of their stretches, node after node, ``times`` how many each has."""

    def __init__(self, ids: np.ndarray, text_of: np.ndarray):
        self.left, self.cut, self.right, self.places, self.times = [], [], [], [], []
        symbol, start = ids.astype(np.int64), np.arange(len(ids))
        end = start + 1
        inside = np.concatenate((text_of[1:] == text_of[:-1], [False])) if len(ids) else np.zeros(0, bool)
        fresh = int(ids.max(initial=0)) + 1
        open_ = inside.copy()  # a pair that occurred once stays rare until one of its symbols changes
        salt = np.random.default_rng(5).integers(1, 1 << 62, 64)
        for turn in range(1 << 30):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            _, kind, count = np.unique(symbol[at] * fresh + symbol[at + 1], return_inverse=True, return_counts=True)
            often = count[kind] > 1
            open_[at[~often]] = False
            at, kind = at[often], kind[often]
            if not len(at):
                break
            # Most frequent first, by powers of two; a salted order among these lets most pairs win somewhere.
            shuffled = np.argsort(np.argsort((np.arange(len(count)) * 0x9E3779B97F4A7C1 ^ salt[turn % 64]) * 0x2545F4914F6CDD1 % (1 << 61)))
            rank = np.zeros(len(symbol) + 2, np.int64)
            rank[at + 1] = (np.floor(np.log2(count[kind])).astype(np.int64) + 1) * (len(count) + 1) + shuffled[kind]
            # Stretches of one pair (x x x ...) count as one: every second place of a winning stretch is replaced.
            edge = np.flatnonzero(np.diff(rank))  # rank[edge] != rank[edge + 1]
            first, last = edge[:-1] + 1, edge[1:]
            wins = (rank[first] > rank[first - 1]) & (rank[first] > rank[last + 1]) & (rank[first] > 0)
            first, last = first[wins] - 1, last[wins] - 1
            sizes = (last - first) // 2 + 1
            put = np.repeat(first, sizes) + 2 * (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            of = np.full(len(symbol), -1)
            of[at] = kind
            self._add(of[put], start[put], end[put], end[put + 1])
            names, new = np.unique(of[put], return_inverse=True)
            symbol[put], end[put], inside[put] = fresh + new, end[put + 1], inside[put + 1]
            fresh += len(names)
            open_[put] = True
            open_[put[put > 0] - 1] = True
            keep = np.ones(len(symbol), bool)
            keep[put + 1] = False
            symbol, start, end, inside = symbol[keep], start[keep], end[keep], inside[keep]
            open_ = open_[keep] & inside
        self._balance(start, end, inside)

    def _add(self, kind: np.ndarray, left: np.ndarray, cut: np.ndarray, right: np.ndarray) -> None:
        long = right - left >= MIN_WORDS
        kind, left, cut, right = kind[long], left[long], cut[long], right[long]
        order = np.argsort(kind, kind="stable")
        firsts = np.flatnonzero(np.diff(kind[order], prepend=-2))
        here = order[firsts]
        self.left.append(left[here])
        self.cut.append(cut[here])
        self.right.append(right[here])
        self.places.append(left[order])
        self.times.append(np.diff(np.append(firsts, len(order))))

    def _balance(self, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> None:
        while inside.any():
            new = np.concatenate(([True], ~inside[:-1]))
            first = np.flatnonzero(new)
            number = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
            put = np.flatnonzero((number % 2 == 0) & inside)
            self._add(np.arange(len(put)), start[put], end[put], end[put + 1])
            end[put], inside[put] = end[put + 1], inside[put + 1]
            keep = np.ones(len(start), bool)
            keep[put + 1] = False
            start, end, inside = start[keep], end[keep], inside[keep]


def returns(ids: np.ndarray, text_of: np.ndarray):
    """Positions sorted by their four words and text (the composite ``key`` rises along them), and each one's rank."""
    n = len(ids)
    gram = text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate((ids, np.arange(GRAM - 1) + int(ids.max(initial=0)) + 1)).astype(np.uint64)
    for k in range(GRAM):
        gram = (gram ^ padded[k:k + n] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    group = np.cumsum(np.diff(gram[order], prepend=gram[order[:1]]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order, group * (n + 1) + order, rank, group[rank]


def crossing(ids: np.ndarray, text_of: np.ndarray, grammar: Grammar, seed: int) -> np.ndarray:
    """(place, end, period) of the intervals that cross the boundary of a nonterminal, at every place it has."""
    none = np.zeros((0, 3), np.int64)
    if not any(map(len, grammar.left)):
        return none
    left, cut, right, places, times = (np.concatenate(x) for x in (
        grammar.left, grammar.cut, grammar.right, grammar.places, grammar.times))
    n = len(ids)
    order, key, rank, group = returns(ids, text_of)
    hashes = StretchHashes(ids, seed)
    factor = small_factors(max(2, int((right - left).max())))
    half = -(-MIN_WORDS // 2)
    found = []
    for forward in (True, False):
        room = right - cut if forward else cut - left
        own = np.flatnonzero(room >= max(half, GRAM + 1))
        anchor = cut[own] if forward else cut[own] - GRAM
        reach = room[own] * 2 // MIN_PERIODS  # the longer part of a run holds half of three periods
        if forward:
            lo = rank[anchor] + 1
            hi = np.searchsorted(key, group[anchor] * (n + 1) + np.minimum(anchor + reach, right[own] - GRAM), "right")
        else:
            lo = np.searchsorted(key, group[anchor] * (n + 1) + np.maximum(anchor - reach, left[own]), "left")
            hi = rank[anchor]
        size = np.maximum(hi - lo, 0)
        some = np.flatnonzero(size)
        total = np.cumsum(size[some])
        at = 0
        while at < len(some):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
            part = some[at:stop]
            at = stop
            node = np.repeat(part, size[part])
            which = np.repeat(lo[part], size[part]) + np.arange(len(node)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            q = np.abs(order[which] - anchor[node])
            node = own[node]
            # The longer part has this many words of the period at least, and no smaller period.
            need = np.maximum(half, -(-MIN_PERIODS * q // 2))
            ok = need <= room[node]
            node, q, need = node[ok], q[ok], need[ok]
            base = cut[node] if forward else cut[node] - need
            ok = hashes.same(base, base + q, need - q)
            node, q, need, base = node[ok], q[ok], need[ok], base[ok]
            rest = q.copy()
            least = np.ones(len(q), bool)
            while (rest > 1).any():
                f = np.where(rest > 1, factor[rest], 1)
                d = q // f
                least &= (f == 1) | ~hashes.same(base, base + d, need - d)
                rest = np.where(rest > 1, rest // f, 1)
            node, q = node[least], q[least]
            if not len(q):
                continue
            b, l, r = cut[node], left[node], right[node]
            if forward:
                last = b + q + hashes.ahead(b, b + q, r - b - q)
                first = b - hashes.behind(b, b + q, b - l)
            else:
                first = b - q - hashes.behind(b - q, b, b - q - l)
                last = b + hashes.ahead(b - q, b, r - b)
            ok = (last - first >= np.maximum(MIN_WORDS, MIN_PERIODS * q))
            found.append(np.stack((node[ok], first[ok] - l[ok], last[ok] - l[ok], q[ok]), 1))
    if not found:
        return none
    one = np.unique(np.concatenate(found), axis=0)
    size = times[one[:, 0]]
    many = np.repeat(one, size, axis=0)
    spot = places[np.repeat(np.cumsum(times)[one[:, 0]] - np.cumsum(size), size) + np.arange(len(many))]
    return np.stack((spot + many[:, 1], spot + many[:, 2], many[:, 3]), 1)


def merged(intervals: np.ndarray) -> np.ndarray:
    """Intervals of one period that overlap by a period become one; by start, then period."""
    if not len(intervals):
        return intervals
    first, last, q = intervals[np.lexsort((intervals[:, 1], intervals[:, 0], intervals[:, 2]))].T
    jump = (np.cumsum(np.diff(q, prepend=q[0]) != 0)) * (int(last.max()) + 1)
    top = np.maximum.accumulate(last + jump) - jump
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (first[1:] + q[1:] > top[:-1])))
    heads = np.flatnonzero(new)
    out = np.stack((first[heads], np.maximum.reduceat(last, heads), q[heads]), 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def holds(ids: np.ndarray, text_of: np.ndarray, run: Sequence[int]) -> bool:
    """The words of a run have its period, and no neighbour in its text extends it."""
    i, j, q = run
    if not np.array_equal(ids[i:j - q], ids[i + q:j]) or text_of[i] != text_of[j - 1]:
        return False
    before = i > 0 and text_of[i - 1] == text_of[i] and ids[i - 1] == ids[i - 1 + q]
    after = j < len(ids) and text_of[j] == text_of[i] and ids[j] == ids[j - q]
    return not before and not after


def find_runs(ids: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """(start, end, period) of every run of the concatenated texts, by start, then period."""
    grammar = Grammar(ids, text_of)
    for seed in range(8):
        runs = merged(crossing(ids, text_of, grammar, seed))
        if all(holds(ids, text_of, r) for r in runs.tolist()):
            return runs
    raise RuntimeError("stretch hashes keep colliding")


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words with the repetition that the crc32 of the id plants into every tenth text."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def digest(words: list[bytes], runs: list[list[int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of one text."""
    said = hashlib.sha256("".join(f"{i},{j - i},{q}\n" for i, j, q in runs).encode()).hexdigest()
    top = (None,) * 4
    kept = words
    if runs:
        i, j, q = runs[0]
        for x, y, z in runs[1:]:
            if (y - x) * q > (j - i) * z or ((y - x) * q == (j - i) * z and (x, z) < (i, q)):
                i, j, q = x, y, z
        top = (i, j - i, q, 1000 * (j - i) // q)
        gone = np.zeros(len(words) + 1, np.int64)
        for x, y, z in runs:
            gone[x + z] += 1
            gone[y] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return (len(runs), *top, said, hashlib.sha256(b" ".join(kept)).hexdigest())


def text_runs(texts: list[list[bytes]]) -> Iterator[list[list[int]]]:
    """The runs (start, end, period) of each text, given as lists of words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    runs = find_runs(ids, text_of)
    first = np.cumsum(sizes) - sizes
    of = text_of[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        own = runs[bounds[k]:bounds[k + 1]]
        yield (own - [first[k], first[k], 0]).tolist()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """Per row: id, n_runs, the run of the greatest exponent, digests of all runs and of the text without repeats.

    With ``plant``, every tenth text (by the crc32 of its id) first gets the
    repetition that makes detection testable.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out, at = batch.column(0).to_pylist(), [], 0
        while at < batch.num_rows:
            texts, size = [], 0
            while at + len(texts) < batch.num_rows and (not texts or size < SLICE_BYTES):
                k = at + len(texts)
                text = (batch.column(1)[k].as_py() or "").encode("utf-8", "surrogatepass")
                size += len(text)
                words = text.split()  # bytes split at the six ASCII spaces only
                texts.append(planted(words, ids[k]) if plant else words)
            out += [digest(t, r) for t, r in zip(texts, text_runs(texts), strict=True)]
            at += len(texts)
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    schema = (f"id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")
    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema).withColumnRenamed("id", id_col)

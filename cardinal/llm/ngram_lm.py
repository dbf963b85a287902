"""Operator 9: language-model scores from an Elias-Fano n-gram trie.

Tokens are the words of a text (A-Z lowered) and one end.  Order 1 is
(c + 0.5) / (N + 0.5 (V + 1)); orders 2 and 3 are smoothed towards the order
below by a Dirichlet prior: p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K).

Training is four jobs over all training texts; each task counts its own
n-grams first, and what is shuffled are sorted, compressed count tables, one
for each shard:

1. vocabulary: tokens by 64-bit hash, in hash order; a token's id is its place;
2. level 2: each word's successors, ids in Elias-Fano code;
3. level 3: each bigram's successors, not as ids but as places in the successor
   list of the bigram's last word (context-relative, so small numbers);
4. scoring.

The trie is cut into shards along (first word, second word), weighted by the
first word's count, so frequent words spread over several shards.  Shards are
files in the folder of ``spark.checkpoint.dir``, written whole by one task
each under a temporary name and renamed, so lost tasks repeat harmlessly, and
memory-mapped by the scoring tasks, which go through their n-grams shard by
shard.  Where that folder is not a mounted path, a shard is read through its
file system instead.  Probabilities are quantised to 256 levels per shard and
level; unigram counts are kept exactly.

Cases: a null or empty text is one end token; null ids are learned from and
scored like held-in ones; without training texts N and V are 0 and every
token scores log10(0.5 / 0.5) = 0; repeated rows count and score each; very long
texts are cut into overlapping stretches; extra columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import checkpoint_dir
from cardinal.llm.elias_fano import Level, encode_level
from cardinal.llm.shingles import word_hashes

K2, K3 = 300.0, 20.0
STRETCH = 1 << 21  # tokens of a task that are counted at once
SCORE_STRETCH = 1 << 20  # and that are scored at once
HASH_BYTES = 1 << 17  # of whole texts hashed at once
SHARD_TOKENS = 2_000_000
END = np.uint64(0xE0D0_0000_0000_0001)
CODES = 256


# -- shared files -----------------------------------------------------------

def local_path(uri: str) -> str | None:
    """The mounted path of a folder, or None if it is in another file system."""
    got = urlparse(uri)
    return unquote(got.path) if got.scheme in ("", "file") else None


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays behind a JSON header, in one file that appears whole."""
    heads, at = {}, 0
    for k, v in arrays.items():
        heads[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 64) * 64
    head = json.dumps(heads).encode()
    size = -(-(len(head) + 8) // 64) * 64

    def write(f):
        f.write((len(head).to_bytes(8, "little") + head).ljust(size, b"\0"))
        for v in arrays.values():
            f.write(v.tobytes().ljust(-(-v.nbytes // 64) * 64, b"\0"))

    path = local_path(folder)
    own = f"{name}.{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{own}", "wb") as f:
            write(f)
        os.replace(f"{path}/{own}", f"{path}/{name}")
    else:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{own}") as f:
            write(f)
        store.move(f"{root}/{own}", f"{root}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped where the folder is mounted."""
    path = local_path(folder)
    if path is not None:
        with open(f"{path}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{name}") as f:
            data = f.read()
    n = int.from_bytes(data[:8], "little")
    size = -(-(n + 8) // 64) * 64
    return {k: np.frombuffer(data, np.dtype(t), count, size + at) for k, (t, at, count) in json.loads(data[8:8 + n]).items()}


def squeeze(*columns: np.ndarray) -> bytes:
    """Equally long integer columns, the first one rising (stored as steps), compressed."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    body = b"".join(np.ascontiguousarray(c).tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(body)


def unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = len(body) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(body, k, n, at))
        at += out[-1].nbytes
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


# -- tokens -----------------------------------------------------------------

def stretches(batches, limit: int):
    """Yield (rows, hash, text number, place) for runs of rows of (text, ...) batches, of like size."""
    for b in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 4 * limit):
                size += len(texts[stop]) + 1
                stop += 1
            yield b.slice(at, stop - at), *tokens(texts[at:stop])
            at = stop


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place up to 2) of every token of some texts, ends included."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.unique(np.concatenate((first[np.searchsorted(first, np.arange(0, first[-1], HASH_BYTES))], first[-1:])))
    parts = [(a, *word_hashes(raw[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    h, start = np.concatenate([p[1] for p in parts]), np.concatenate([p[0] + p[2] for p in parts])
    bounds = np.searchsorted(start, first)
    n = np.diff(bounds) + 1
    ends = np.cumsum(n) - 1
    out = np.empty(int(n.sum()), np.uint64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = h
    out[ends] = END
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(out)) - np.repeat(ends - n + 1, n)
    return out, text, np.minimum(place, 2)


def pieces(n: int, limit: int):
    for at in range(0, n, limit):
        yield at, min(n, at + limit)


# -- the model --------------------------------------------------------------

@dataclass
class Trie:
    """What every task needs to know; the levels are in files."""

    folder: str
    vocab_bits: int
    starts: np.ndarray  # first id of each vocabulary bucket, and V
    before: np.ndarray  # training tokens before each bucket, and N
    shards: int
    carry: dict[int, tuple[int, int]] = field(default_factory=dict)  # shard -> (its first word, successors before it)

    @property
    def n(self) -> int:
        return int(self.before[-1])

    @property
    def v(self) -> int:
        return int(self.starts[-1])

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens before it in id order) of sorted distinct hashes."""
        n = len(hashes)
        ident, count, before = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        bucket = vocab_bucket(hashes, self.vocab_bits)
        edges = np.searchsorted(bucket, np.arange((1 << self.vocab_bits) + 1))
        for k in range(1 << self.vocab_bits):
            a, b = edges[k], edges[k + 1]
            if a == b or self.starts[k] == self.starts[k + 1]:
                continue
            got = vocabulary_bucket(self.folder, k)
            at = np.searchsorted(got["hash"], hashes[a:b])
            at[at == len(got["hash"])] = 0
            hit = np.flatnonzero(got["hash"][at] == hashes[a:b])
            at = at[hit]
            ident[a + hit] = self.starts[k] + at
            count[a + hit] = got["upto"][at + 1] - got["upto"][at]
            before[a + hit] = self.before[k] + got["upto"][at]
        return ident, count, before

    def shard(self, before: np.ndarray, count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of n-grams by their first word's (before, count) and second word's id: rising in both."""
        x = (before + count * (second / max(self.v, 1))) * (self.shards / max(self.n, 1))
        return np.minimum(x.astype(np.int64), self.shards - 1)

    def bigrams(self, first: np.ndarray, second: np.ndarray, shard: np.ndarray):
        """(node in its shard or -1, place in the first word's list, log10 p, log10 weight of the order below)."""
        n = len(first)
        node, rel = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        p, weight = np.zeros(n), np.zeros(n)
        for s, at in by_shard(shard):
            got = self.level(2, s)
            if got is None:
                continue
            level, data = got
            context = first[at] - int(data["first"][0])
            inside = np.flatnonzero((context >= 0) & (context < level.ptr.n - 1))
            found, place = level.search(context[inside], second[at][inside])
            hit = np.flatnonzero(found >= 0)
            to, found, place = at[inside[hit]], found[hit], place[hit]
            word, more = self.carry.get(s, (-1, 0))
            node[to], rel[to] = found, place + more * (first[to] == word)
            p[to] = data["p_book"][data["p"][found]]
            weight[to] = data["w_book"][data["w"][found]]
        return node, rel, p, weight

    def trigrams(self, shard: np.ndarray, node: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, log10 p) of a successor, by its place in its context's list, below a bigram's node."""
        hit, p = np.zeros(len(node), bool), np.zeros(len(node))
        for s, at in by_shard(shard):
            got = self.level(3, s)
            if got is None:
                continue
            level, data = got
            found, _ = level.search(node[at], rel[at])
            ok = np.flatnonzero(found >= 0)
            hit[at[ok]] = True
            p[at[ok]] = data["p_book"][data["p"][found[ok]]]
        return hit, p

    def level(self, order: int, s: int):
        """A shard's level and its other arrays; None where the shard has no such n-grams."""
        key = (self.folder, order, s)
        if key not in _LEVELS:
            try:
                data = load(self.folder, f"level{order}-{s}")
            except FileNotFoundError:
                return None
            if local_path(self.folder) is None:  # read, not mapped: hold one at a time
                _LEVELS.clear()
            _LEVELS[key] = (Level(data), data)
        return _LEVELS[key]


_LEVELS: dict = {}
_VOCABULARY: dict = {}


def vocabulary_bucket(folder: str, k: int) -> dict[str, np.ndarray]:
    """A bucket of the vocabulary, mapped once by each worker."""
    if (folder, k) not in _VOCABULARY:
        data = load(folder, f"vocab-{k}")
        if local_path(folder) is None or any(f != folder for f, _ in _VOCABULARY):  # read, not mapped; or of an earlier model
            _VOCABULARY.clear()
        _VOCABULARY[folder, k] = data
    return _VOCABULARY[folder, k]


def by_shard(shard: np.ndarray):
    """(shard, positions) of each shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    seen, at = np.unique(shard[order], return_index=True)
    for s, part in zip(seen, np.split(order, at[1:]), strict=True):
        yield int(s), part


def vocab_bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, value of each code): equally wide bins of the logarithms, each standing for its mean."""
    low = values.min()
    step = max((values.max() - low) / CODES, 1e-12)
    code = np.minimum((values - low) / step, CODES - 1).astype(np.uint8)
    n = np.bincount(code, minlength=CODES)
    return code, np.bincount(code, weights=values, minlength=CODES) / np.maximum(n, 1)


def grouped(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by their keys, equal ones added up."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def tables(docs: DataFrame, count, schema: str = "shard int, blob binary") -> DataFrame:
    """Each task's count tables: ``count(hashes, place, lo, hi)`` yields (shard, blob) of a stretch."""

    def run(batches):
        for _, h, _, place in stretches(batches, STRETCH):
            for lo, hi in pieces(len(h), STRETCH):
                got = list(count(h, place, lo, hi))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()),
                                                      pa.array([b for _, b in got], pa.binary())], names=["shard", "blob"])

    return docs.mapInArrow(run, schema)


def vocabulary(docs: DataFrame, folder: str, bits: int) -> Trie:
    """Job 1: writes the vocabulary's buckets."""

    def count(h, place, lo, hi):
        word, n = np.unique(h[lo:hi], return_counts=True)
        bucket = vocab_bucket(word, bits)
        edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for k in np.unique(bucket):
            a, b = edges[k], edges[k + 1]
            yield int(k), squeeze(word[a:b], n[a:b].astype("<u4"))

    def build(key, table):
        parts = [unsqueeze(b, "<u8", "<u4") for b in table.column("blob").to_pylist()]
        (word,), n = grouped([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]).astype(np.int64))
        k = key[0].as_py()
        save(folder, f"vocab-{k}", {"hash": word, "upto": np.concatenate(([0], np.cumsum(n)))})
        return pa.table({"bucket": pa.array([k], pa.int32()), "words": pa.array([len(word)], pa.int64()),
                         "tokens": pa.array([int(n.sum())], pa.int64())})

    made = tables(docs, count).groupBy("shard").applyInArrow(build, "bucket int, words bigint, tokens bigint").collect()
    words, total = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in made:
        words[r["bucket"]], total[r["bucket"]] = r["words"], r["tokens"]
    starts, before = (np.concatenate(([0], np.cumsum(x))) for x in (words, total))
    return Trie(folder, bits, starts, before, max(1, -(-int(before[-1]) // SHARD_TOKENS)))


def local_ids(trie: Trie, h: np.ndarray, lo: int, hi: int):
    """(offset, local number of each token, and of each local word: id, count, before) of a stretch with its context."""
    start = max(0, lo - 2)
    word, local = np.unique(h[start:hi], return_inverse=True)
    return start, local.astype(np.int64), *trie.ids(word)


def level_two(docs: DataFrame, trie: Trie) -> None:
    """Job 2: writes each shard's words with their successors; notes where a shard goes on with a word."""

    def count(h, place, lo, hi):
        start, local, ident, n, before = local_ids(trie, h, lo, hi)
        at = np.flatnonzero(place[lo:hi] > 0) + lo - start
        pair, c = np.unique(local[at - 1] << 22 | local[at], return_counts=True)
        a, b = pair >> 22, pair & ((1 << 22) - 1)
        for s, part in by_shard(trie.shard(before[a], n[a], ident[b])):
            key = ident[a[part]] << 32 | ident[b[part]]
            order = np.argsort(key, kind="stable")
            yield s, squeeze(key[order], c[part][order].astype("<u4"))

    def build(key, table):
        parts = [unsqueeze(b, "<i8", "<u4") for b in table.column("blob").to_pylist()]
        (pair,), c = grouped([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]).astype(np.int64))
        s, first, second = key[0].as_py(), pair >> 32, pair & 0xFFFFFFFF
        below = 10 ** trie.unigram(counts_of(trie, second))
        p, p_book = quantise(np.log10((c + K2 * below) / (counts_of(trie, first) + K2)))
        w, w_book = quantise(np.log10(K3 / (c + K3)))
        save(trie.folder, f"level2-{s}", encode_level(first - first[0], second, int(first[-1] - first[0]) + 1) | {
            "first": first[:1], "p": p, "p_book": p_book, "w": w, "w_book": w_book, "count": c})
        return pa.table({"shard": pa.array([s], pa.int32()), "first": pa.array(first[:1]), "last": pa.array(first[-1:]),
                         "own": pa.array([int((first == first[-1]).sum())], pa.int64())})

    made = tables(docs, count).groupBy("shard").applyInArrow(build, "shard int, first bigint, last bigint, own bigint").collect()
    word, more = -1, 0
    for r in sorted(made, key=lambda r: r["shard"]):
        if r["first"] == word:
            trie.carry[r["shard"]] = (word, more)
        more = r["own"] + (more if r["first"] == word and r["last"] == word else 0)
        word = r["last"]


def counts_of(trie: Trie, ident: np.ndarray) -> np.ndarray:
    """Training counts of ids."""
    out = np.zeros(len(ident), np.int64)
    bucket = np.searchsorted(trie.starts, ident, side="right") - 1
    for k, at in by_shard(bucket):
        upto = vocabulary_bucket(trie.folder, k)["upto"]
        j = ident[at] - trie.starts[k]
        out[at] = upto[j + 1] - upto[j]
    return out


def befores_of(trie: Trie, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens before it, count) of ids."""
    out, n = np.zeros(len(ident), np.int64), np.zeros(len(ident), np.int64)
    bucket = np.searchsorted(trie.starts, ident, side="right") - 1
    for k, at in by_shard(bucket):
        upto = vocabulary_bucket(trie.folder, k)["upto"]
        j = ident[at] - trie.starts[k]
        out[at], n[at] = trie.before[k] + upto[j], upto[j + 1] - upto[j]
    return out, n


def level_three(docs: DataFrame, trie: Trie) -> None:
    """Job 3: writes each shard's bigrams with their successors, as places in the list of the bigram's last word."""

    def count(h, place, lo, hi):
        start, local, ident, n, before = local_ids(trie, h, lo, hi)
        at = np.flatnonzero(place[lo:hi] > 1) + lo - start
        for key, c in packed_trigrams(local, at):
            a, b, w = key
            for s, part in by_shard(trie.shard(before[a], n[a], ident[b])):
                pair, third = ident[a[part]] << 32 | ident[b[part]], ident[w[part]]
                order = np.lexsort((third, pair))
                yield s, squeeze(pair[order], third[order].astype("<u4"), c[part][order].astype("<u4"))

    def build(key, table):
        parts = [unsqueeze(b, "<i8", "<u4", "<u4") for b in table.column("blob").to_pylist()]
        (pair, third), c = grouped([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)],
                                   np.concatenate([p[2] for p in parts]).astype(np.int64))
        s = key[0].as_py()
        level, data = trie.level(2, s)
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        own = np.cumsum(new) - 1
        bigram = pair[new]
        node, _ = level.search((bigram >> 32) - int(data["first"][0]), bigram & 0xFFFFFFFF)
        second = pair & 0xFFFFFFFF
        tail, back = np.unique(second << 32 | third, return_inverse=True)  # the bigrams that the trigrams end with
        before, n = befores_of(trie, tail >> 32)
        _, rel, p2, _ = trie.bigrams(tail >> 32, tail & 0xFFFFFFFF, trie.shard(before, n, tail & 0xFFFFFFFF))
        p, p_book = quantise(np.log10((c + K3 * 10 ** p2[back]) / (data["count"][node][own] + K3)))
        save(trie.folder, f"level3-{s}", encode_level(node[own], rel[back], level.val.n) | {"p": p, "p_book": p_book})
        return pa.table({"shard": pa.array([s], pa.int32()), "n": pa.array([len(c)], pa.int64())})

    tables(docs, count).groupBy("shard").applyInArrow(build, "shard int, n bigint").collect()


def packed_trigrams(local: np.ndarray, at: np.ndarray):
    """((first, second, third) local numbers, counts) of the trigrams that end at ``at``."""
    if not len(at):
        return
    low = (1 << 21) - 1
    if int(local.max()) <= low:
        key, c = np.unique(local[at - 2] << 42 | local[at - 1] << 21 | local[at], return_counts=True)
        yield (key >> 42, key >> 21 & low, key & low), c
    else:
        (a, b, w), c = grouped([local[at - 2], local[at - 1], local[at]], np.ones(len(at), np.int64))
        yield (a, b, w), c


def score_stretch(trie: Trie, h: np.ndarray, place: np.ndarray, lo: int, hi: int):
    """(count, base, score) of the tokens from lo to hi."""
    start, local, ident, n, before = local_ids(trie, h, lo, hi)
    count = n[local]
    one = trie.unigram(count)
    word = ident[local]
    # Distinct bigrams of known words, looked up once each.
    here = place[start:hi].copy()
    here[0] = 0  # what comes before the stretch is only looked back on
    at = np.flatnonzero(here > 0)
    at = at[(word[at] >= 0) & (word[at - 1] >= 0)]
    pair, back = np.unique(local[at - 1] << 22 | local[at], return_inverse=True)
    a, b = pair >> 22, pair & ((1 << 22) - 1)
    shard = trie.shard(before[a], n[a], ident[b])
    node, rel, p, weight = trie.bigrams(ident[a], ident[b], shard)
    of = np.full(len(local), -1, np.int64)
    of[at] = back
    found = of >= 0
    found[at] = node[back] >= 0
    # Order 2: the bigram, or the first word's weight times order 1.
    two = one.copy()
    prior = np.flatnonzero(here > 0)
    prior = prior[word[prior - 1] >= 0]
    two[prior] += np.log10(K2 / (count[prior - 1] + K2))
    two[found] = p[of[found]]
    # Order 3: the trigram, or the bigram context's weight times order 2.
    three = two.copy()
    deep = np.flatnonzero((here > 1) & np.concatenate(([False], found[:-1])))
    three[deep] += weight[of[deep - 1]]
    ask = deep[found[deep]]
    if len(ask):
        ask = ask[np.argsort(of[ask - 1])]  # in the order of the contexts: neighbours are looked up together
        context = of[ask - 1]
        hit, p3 = trie.trigrams(shard[context], node[context], rel[of[ask]])
        three[ask[hit]] = p3[hit]
    cut = lo - start
    return count[cut:], one[cut:], three[cut:]


def train(docs: DataFrame, text_col: str = "text") -> Trie:
    """Writes the trie of all texts of ``docs`` and returns its description."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    trie = vocabulary(texts, folder, max(0, min(16, (parts - 1).bit_length())))
    if trie.n:
        level_two(texts, trie)
        level_three(texts, trie)
    return trie


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for rows, h, text, place in stretches(batches, SCORE_STRETCH):
            n = rows.num_rows
            sums = [np.zeros(n) for _ in range(4)]
            for lo, hi in pieces(len(h), SCORE_STRETCH):
                count, base, full = score_stretch(trie, h, place, lo, hi)
                of = text[lo:hi]
                for total, x in zip(sums, (None, count > 0, base, full), strict=True):
                    total += np.bincount(of, weights=x, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), *[pa.array(x.astype(np.int64)) for x in sums[:2]],
                 pa.array(np.full(n, trie.n, np.int64)), *[pa.array(x) for x in sums[2:]]], names=names)

    return docs.select(F.col(text_col).cast("string"), id_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def train_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows where ``training`` is true (or null) and scores all rows."""
    return score(docs, train(docs.where(F.coalesce(training, F.lit(True))), text_col), id_col, text_col)

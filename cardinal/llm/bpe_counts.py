"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A word is a doubly linked list of symbols; a heap holds its adjacent pairs
by merge rank.  The lowest-ranked pair is popped and merged until no pair is
left, and the word counts *initial symbols minus merges*: no identifier is
emitted.  The vocabulary file is read where the tasks run, by a path that is
a parameter; nothing is trained.

Text handling follows the tokenizer file: special strings found in the raw
text count one each, the rest is NFC-normalised, lower-cased character by
character, cut into words by the file's pattern, and white space vanishes.
White space never joins two words, so counts are kept per white-space
separated chunk in a bounded two-generation cache.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated ids give one
row each; very long texts are counted whole; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cardinal.llm.common import arrow_map

SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
SHIFT = 17  # symbol ids of the supported vocabularies stay below 2**17
MASK = (1 << SHIFT) - 1


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    shown = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Counts the byte-pair tokens of words for a tokenizer file with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[vocab[a] << SHIFT | vocab[b]] = rank << SHIFT | vocab[a + b]
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        # The pattern names white space only inside a negated class; spell that class out.
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", SPACE))

    def word(self, raw: bytes) -> int:
        """Tokens of one word's bytes."""
        n = len(raw)
        if n < 2:
            return n
        find, inner = self.pairs.get, self.inner
        sym = [inner[b] for b in raw]
        sym[-1] = self.final[raw[-1]]
        heap = []  # a pair as rank * n + place of its left symbol: orders by rank, then by place
        left = sym[0]
        for i in range(1, n):
            right = sym[i]
            hit = find(left << SHIFT | right)
            if hit is not None:
                heap.append((hit >> SHIFT) * n + i - 1)
            left = right
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            k = after[i]
            if sym[i] < 0 or k >= n:
                continue
            hit = find(sym[i] << SHIFT | sym[k])
            if hit is None or hit >> SHIFT != rank:
                continue  # one of the two was merged elsewhere since the pair was pushed
            merges += 1
            new = sym[i] = hit & MASK
            sym[k] = -1
            k = after[i] = after[k]
            if k < n:
                before[k] = i
                hit = find(new << SHIFT | sym[k])
                if hit is not None:
                    heappush(heap, (hit >> SHIFT) * n + i)
            k = before[i]
            if k >= 0:
                hit = find(sym[k] << SHIFT | new)
                if hit is not None:
                    heappush(heap, (hit >> SHIFT) * n + k)
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return sum(map(self.cached_word, self.words.findall(text.lower())))

    def cached_word(self, word: str) -> int:
        return self.word(word.encode("utf-8", "surrogatepass"))

    def text(self, text: str) -> int:
        """Tokens of any text."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts)


class Generations(dict):
    """A cache with a bound: when full, it becomes the old generation and an empty one begins.

    ``cache[key]`` computes missing values; what is still in use moves back
    from the old generation.  Dropping entries costs time only.
    """

    def __init__(self, compute, limit: int, longest: int):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def foldable(raw: bytes) -> bool:
    """True where lowering ASCII letters first cannot change the tokens.

    The normaliser lowers anyway; only special strings and combining marks
    (U+0300 to U+036F, which compose before lowering) see the difference.
    """
    return b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw


_COUNTERS: dict[str, Generations] = {}


def counter(path: str, entries: int = 600_000) -> Generations:
    """This worker's cache of chunk -> token count for one tokenizer file."""
    if path not in _COUNTERS:
        merger = Merger(path)
        words = Generations(merger.cached_word, entries, 48)
        merger.cached_word = words.__getitem__
        _COUNTERS[path] = Generations(lambda chunk: merger.text(chunk.decode("utf-8", "surrogatepass")), entries, 48)
    return _COUNTERS[path]


def count_text(text: str | None, cache: Generations) -> tuple[int, int]:
    """(UTF-8 bytes, tokens) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    chunks = (raw.lower() if foldable(raw) else raw).split()
    return len(raw), sum(map(cache.__getitem__, chunks))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit.  No shuffle; one pass over the texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = counter(tokenizer)
        got = [count_text(t.as_py(), cache) for t in batch.column(1)]
        tokens = [t for _, t in got]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array(tokens, pa.int64()),
             pa.array([t > limit for t in tokens], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(id_col, text_col), run,
                     f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

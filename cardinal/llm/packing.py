"""Operator 7: best-fit packing by bin completion.

Texts become token ids plus one closing id; only documents longer than a
sequence are cut, into full pieces and a shorter last one.  What is to be
packed is then a multiset of lengths 1..capacity, so the search needs the
*histogram of lengths* only: at most ``capacity`` numbers, however many
documents there are.  It returns fillings with multiplicities ("this filling,
900 times"), and each piece finds its place from its rank among the pieces
of its length.  Texts are read once and never shuffled.

Search: best-fit decreasing gives the incumbent.  While it uses more sequences
than the bound ceil(total / capacity), branch and bound goes through the
undominated fillings around the largest remaining length, and prunes by the
waste that a better packing could still afford.  ``max_nodes`` bounds the
search; the incumbent is complete at any time, so no piece is ever left out.

Cases: a null or empty text is one piece of length 1 (the closing id);
repeated rows are packed each; no rows give no rows; ids may be null; extra
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.bpe_counts import Generations, foldable
from cardinal.llm.common import arrow_map, in_order, reliable_checkpoint, seeded_ranks
from cardinal.operators.ranking import RN, ordered_numbers

CAPACITY = 4096
END_ID = 1
SEARCH_NODES = 1_000
SEARCH_WIDTH = 8

Filling = tuple[tuple[int, int], ...]  # (length, how many of it in one sequence), longest first


# -- search over the histogram of lengths -----------------------------------

def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over a histogram: (multiplicity, filling) pairs."""
    open_bins: dict[int, list[list]] = {}  # room left -> [[multiplicity, filling], ...]

    def put(room: int, many: int, filling: Filling) -> None:
        open_bins.setdefault(room, []).append([many, filling])

    def grown(filling: Filling, length: int, k: int) -> Filling:
        if filling and filling[-1][0] == length:
            return (*filling[:-1], (length, filling[-1][1] + k))
        return (*filling, (length, k))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            while left and open_bins.get(room):
                many, filling = open_bins[room].pop()
                fits = room // length
                whole = min(many, left // fits)
                if whole:
                    put(room - fits * length, whole, grown(filling, length, fits))
                    left -= whole * fits
                    many -= whole
                if many and left and left < fits:
                    put(room - left * length, 1, grown(filling, length, left))
                    many, left = many - 1, 0
                if many:
                    put(room, many, filling)
                    if not left:
                        break
            if not open_bins.get(room):
                open_bins.pop(room, None)
        if left:
            fits = capacity // length
            if left // fits:
                put(capacity - fits * length, left // fits, ((length, fits),))
            if left % fits:
                put(capacity - (left % fits) * length, 1, ((length, left % fits),))
    return [(many, filling) for group in open_bins.values() for many, filling in group]


def undominated(counts: dict[int, int], room: int, waste: int, width: int) -> list[Filling]:
    """Up to ``width`` maximal fillings of ``room`` that waste at most ``waste``, least waste first.

    A filling is dominated, and left out, when a larger remaining length
    could stand in for one of its members, or when something still fits.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    found: list[tuple[int, Filling]] = []
    steps = 0

    def dominated(filling: dict[int, int], spare: int) -> bool:
        for x in lengths:
            if counts[x] > filling.get(x, 0) and any(y < x <= y + spare for y in (0, *filling)):
                return True
        return False

    def extend(at: int, spare: int, chosen: dict[int, int]) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= width or steps > 50 * width:
            return
        for k in range(at, len(lengths)):
            x = lengths[k]
            if x > spare:
                continue
            for many in range(min(counts[x], spare // x), 0, -1):
                extend(k + 1, spare - many * x, {**chosen, x: many})
                if len(found) >= width or steps > 50 * width:
                    return
        if spare <= waste and not dominated(chosen, spare):
            found.append((spare, tuple(sorted(chosen.items(), reverse=True))))

    extend(0, room, {})
    return [f for _, f in sorted(set(found))]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = SEARCH_NODES,
                  width: int = SEARCH_WIDTH) -> list[tuple[int, Filling]]:
    """Fillings with multiplicities that pack ``counts`` (length -> how many) into few sequences.

    Depth first over one histogram that is changed and restored, so the memory
    is that of one path.
    """
    left = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in left.items())
    bound = max(-(-total // capacity), sum(n for x, n in left.items() if 2 * x > capacity))
    best = best_fit(left, capacity)
    used = sum(many for many, _ in best)
    path: list[tuple[int, Filling]] = []
    wasted = nodes = 0

    def afford() -> int:
        """Waste that a better packing may still have."""
        return (used - 1) * capacity - total - wasted

    def change(many: int, filling: Filling) -> None:
        for x, k in filling:
            left[x] = left.get(x, 0) + many * k
            if not left[x]:
                del left[x]

    def branches():
        top = max(left)
        others = {**left, top: left[top] - 1}
        found = undominated(others, capacity - top, afford(), width)
        for filling in found or ([()] if capacity - top <= afford() else []):
            one = dict(filling)
            one[top] = one.get(top, 0) + 1
            lost = capacity - sum(x * k for x, k in one.items())
            many = min(left[x] // k for x, k in one.items())
            yield min(many, max(1, afford() // lost)) if lost else many, tuple(sorted(one.items(), reverse=True)), lost

    stack = [branches()] if left and used > bound else []
    while stack and used > bound and nodes < max_nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                many, filling = path.pop()
                change(many, filling)
                wasted -= many * (capacity - sum(x * k for x, k in filling))
            continue
        many, filling, lost = step
        if lost * many > afford():
            continue
        nodes += 1
        change(-many, filling)
        wasted += lost * many
        path.append((many, filling))
        rest = best_fit(left, capacity) if nodes % 16 == 0 or not left else None  # now and then, finish by best fit
        if rest is not None and (n := sum(m for m, _ in path) + sum(m for m, _ in rest)) < used:
            best, used = [*path, *rest], n
        stack.append(branches() if left and afford() >= 0 else iter(()))
    return best


def places(plan: list[tuple[int, Filling]]) -> dict[str, np.ndarray]:
    """The plan as sorted columns: which ranks of which length go to which sequences and offsets."""
    rows, taken, sequence = [], {}, 0
    for many, filling in plan:
        offset = 0
        for length, k in filling:
            rows.append((length, taken.get(length, 0), k, sequence, offset))
            taken[length] = taken.get(length, 0) + many * k
            offset += length * k
        sequence += many
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols, strict=True))


def locate(place: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks (from 0) among their length."""
    span = np.int64(1) << 40
    at = np.searchsorted(place["length"] * span + place["first"], length * span + rank, side="right") - 1
    k = rank - place["first"][at]
    each = place["each"][at]
    return place["sequence"][at] + k // each, place["offset"][at] + (k % each) * length


# -- tokens and pieces ------------------------------------------------------

_ENCODERS: dict[str, Generations] = {}
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def encoder(path: str, entries: int = 500_000) -> Generations:
    """This worker's cache of chunk -> little-endian 32-bit ids, filled by the tokenizer library.

    White space separates chunks and never takes part in a token of the
    supported files, so the ids of a text are those of its chunks in turn.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)

        def ids(chunk: bytes) -> bytes:
            core = chunk.rstrip(MARKS)
            if core != chunk and core[-1:].isalnum() and b"<|" not in chunk:
                # Every pattern ends a token between a letter or digit and a mark that no letter follows.
                cache = _ENCODERS[path]
                return cache[core] + cache[chunk[len(core):]]
            text = chunk.decode("utf-8", "surrogatepass")
            return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        _ENCODERS[path] = Generations(ids, entries, 48)
    return _ENCODERS[path]


def chunks_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if foldable(raw) else raw).split()


def token_bytes(text: str | None, cache: Generations) -> bytes:
    """The ids of a text as consecutive little-endian 32-bit numbers."""
    return b"".join(map(cache.__getitem__, chunks_of(text)))


class Words:
    """Ids of many unknown words by one call of the library.

    The files' last token of a word is marked by a suffix, so the ids of words
    joined by spaces can be told apart.  Every word of letters gives at least one marked token;
    as many of them as words therefore means one each.  Otherwise, or for
    files without the suffix, nothing is learned and words go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tok.get_vocab_size() + 1, dtype=bool)
        if suffix:
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def ids(self, words: list[bytes]) -> list[bytes] | None:
        text = b" ".join(words).decode("utf-8")
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return None
        raw, at = ids.tobytes(), [0, *ends.tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]


_WORDS: dict[str, Words] = {}
JOINED_WORDS = 2_000  # in one call
STRETCH_BYTES = 1 << 20  # of texts whose chunks are held at once


def learn(chunks: set[bytes], path: str, cache: Generations) -> None:
    """Put unknown words of Latin, Greek and Cyrillic letters, and chunks of such a word and ASCII marks, into the cache.

    No mark belongs to the token of the letters before it, so a chunk's ids are those of its two parts.
    """
    unknown: dict[bytes, list[bytes]] = {}
    for chunk in filterfalse(cache.old.__contains__, filterfalse(cache.__contains__, chunks)):
        if len(chunk) <= cache.longest:
            word = chunk.rstrip(MARKS)
            if word.isalpha() or word and (text := word.decode("utf-8", "replace")).isalpha() and max(text) < "\u0500":
                unknown.setdefault(word, []).append(chunk)
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    words = list(unknown)
    for at in range(0, len(words), JOINED_WORDS):
        some = words[at:at + JOINED_WORDS]
        for word, ids in zip(some, _WORDS[path].ids(some) or ()):
            for chunk in unknown[word]:
                cache.put(chunk, ids if chunk == word else ids + cache[chunk[len(word):]])


def texts_bytes(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text, as :func:`token_bytes`; what a stretch of texts has not seen before is encoded together."""
    cache = encoder(path)
    held: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[bytes]:
        learn(set().union(*held), path, cache)
        for chunks in held:
            yield b"".join(map(cache.__getitem__, chunks))
        held.clear()

    for text in texts:
        held.append(chunks_of(text))
        size += len(text or "")
        if size >= STRETCH_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
               text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and the columns ``keep``; one pass over the texts, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    close = np.array([END_ID], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(texts_bytes((text.as_py() for text in batch.column(1)), tokenizer)):
            ids += close
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at := pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
             *[pa.array(x, pa.int64()) for x in (start, length, crc)], *[c.take(at) for c in batch.columns[2:]]],
            names=[id_col, "piece", "start", "length", "ids_crc32", *keep])

    return arrow_map(docs.select(id_col, text_col, *keep), run,
                     f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{more}")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         max_nodes: int = SEARCH_NODES, ordered: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    ``ordered`` keeps to the order of the rows: pieces of equal length take
    their places in it, and sequences are numbered from 0 by their earliest
    piece.  There are as many sequences as without.
    """
    docs, order = in_order(docs) if ordered else (docs, [])
    pieces = reliable_checkpoint(cut_pieces(docs, tokenizer, capacity, id_col, text_col, order))
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    place = places(complete_bins({r["length"]: r["n"] for r in histogram}, capacity, max_nodes))
    if ordered:
        ranked = ordered_numbers(pieces, [*order, "piece"], ["length"]).withColumnRenamed(RN, "rank")
    else:
        keyed = pieces.withColumn("_group", F.col("length").cast("string")).withColumn(
            "_key", F.xxhash64(id_col, "piece", "start", "ids_crc32"))
        ranked = seeded_ranks(keyed, "_group", "_key", (id_col, "piece", "ids_crc32"), bits=6)
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in order)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
        sequence, offset = locate(place, length, rank - 1)
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]],
                                          names=[*batch.schema.names[:5], "sequence_id", "offset", *order])

    packed = arrow_map(ranked.select(id_col, "piece", "start", "length", "ids_crc32", "rank", *order), run,
                       f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                       f"sequence_id bigint, offset bigint{more}")
    if not ordered:
        return packed
    first = packed.groupBy("sequence_id").agg(F.min(F.struct(*order, "piece")).alias("_first"))
    first = first.select(F.col("sequence_id").alias("_old"), "_first.*")
    number = ordered_numbers(first, [*order, "piece"]).select("_old", (F.col(RN) - 1).alias("_new"))
    out = packed.join(number, F.col("sequence_id") == F.col("_old"))
    return out.select(id_col, "piece", "start", "length", "ids_crc32", F.col("_new").alias("sequence_id"), "offset")

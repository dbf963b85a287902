"""Operator 1: near-duplicates by min-max hashing.

A text's set is its distinct word shingles.  Under each of ``PERMUTATIONS``
hash permutations both the smallest and the largest value are kept, so 64
hash evaluations per shingle give 128 signature values; they are banded
``ROWS`` at a time (25 bands: a pair of similarity 0.8 shares no band with
probability 7e-5, of 0.9 with 1e-10).

1. One pass over the texts gives each row its set size, a 128-bit set
   fingerprint and its band keys.  Rows with equal sets form a class (a
   pre-aggregated group by), and only class representatives go on.
2. In each band bucket every member is compared with one pivot, the member
   that meets most others over all its bands: a star, linear in the bucket,
   that ties the members of a group of near copies together.
3. Candidate pairs are confirmed on the full sets, which are made from the
   texts of candidates only.
4. Members of a bucket that are still in different components have to be
   compared with each other, too, and there may be many in a group of middling
   likeness.  They are dealt to bounded blocks; blocks that meet in a bucket
   are compared as wholes, by one product of their incidence matrices, and
   report only links that connect components.  So no candidate pair is given
   up, and pairs are never listed.
5. Components of the confirmed links, by the smallest id.

Cases: a null or empty text has 0 shingles and links with nothing; an id that
occurs in several rows is one node; rows whose id is null take part only
through the class of their text and are never kept; no rows give no rows; extra columns are
ignored (`keep_one` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardinal.llm.common import arrow_map, components, free_name, group_key, release_memory, reliable_checkpoint
from cardinal.llm.shingles import mix, shingle_arrays, shingle_sets
from cardinal.operators.joins import broadcast_if_bounded
from cardinal.operators.ranking import add_row_id

PERMUTATIONS, ROWS = 64, 5
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 100_000
COLUMNS = 50_000  # of an incidence matrix at a time
MAX_BROADCAST_IDS = 1_000_000  # 8-byte ids: beyond, Spark joins by shuffling

_rng = np.random.default_rng(11)
_MULT = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_FOLD = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts with shingles, 2 * PERMUTATIONS): the minimum and the maximum under each permutation."""
    first = np.cumsum(counts) - counts
    first = first[counts > 0]
    out = np.empty((len(first), 2 * PERMUTATIONS), np.uint64)
    value = np.empty_like(hashes)
    for k in range(PERMUTATIONS):
        np.multiply(hashes, _MULT[k], out=value)
        value += _ADD[k]
        out[:, 2 * k] = np.minimum.reduceat(value, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, first)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit bucket keys; the band's number is part of its key."""
    rows = mix(signature[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS))
    return mix((rows * _FOLD).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, fingerprint (x, y) and band keys of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, xs, ys, keys = [], [], [], []
        for _, h, n in shingle_arrays(raw_texts(batch.column(1)), words):
            ends = np.cumsum(n)
            for e, k in zip(ends, n, strict=True):
                s = np.unique(h[e - k:e])
                sizes.append(len(s))
                xs.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                ys.append(int(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)))
            own = band_keys(signatures(h, n)) if len(h) else np.zeros((0, BANDS), np.int64)
            full = np.zeros((len(n), BANDS), np.int64)
            full[n > 0] = own
            keys.append(full)
        flat = np.concatenate(keys).ravel()
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), bands],
            names=["id", "n_shingles", "x", "y", "bands"])

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"id {kind}, n_shingles bigint, x bigint, y bigint, bands array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, n: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the full set of each text whose id is in ``ids`` (column _c, at most n rows), checkpointed."""
    if n <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    texts = texts.join(ids, F.col("id") == F.col("_c"), "left_semi")
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.tobytes() for s in shingle_sets(raw_texts(batch.column(1)), words)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return reliable_checkpoint(arrow_map(texts, make, f"id {kind}, s binary").dropDuplicates())


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The (checkpointed) pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    n = pairs.count()
    if not n:
        return pairs
    kind = docs.schema[id_col].dataType.simpleString()
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("_c")).distinct(), 2 * n, words, id_col, text_col)

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        return batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return arrow_map(met, test, f"a {kind}, b {kind}")


def comparable(percent: int, n: str = "n", m: str = "m"):
    """Sets of these sizes can reach the similarity."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component."""
    joined = members.join(found, F.col("id") == F.col("node"), "left").drop("node")
    joined = joined.withColumn("component", F.coalesce("component", "id"))
    open_keys = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return reliable_checkpoint(joined.join(open_keys.where("lo != hi").select("key"), "key"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` components after more links (a, b) between nodes or components."""
    joins = components(links)
    top = joins.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = found.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = joins.join(found.select("node"), "node", "left_anti")
    return reliable_checkpoint(moved.union(fresh.select("node", "component")))


def in_blocks(left: DataFrame) -> DataFrame:
    """``id``, ``component``, ``block`` of open members: those of one family (the heaviest pivot they meet) are dealt
    by a hash to blocks of about BLOCK_TEXTS texts and BLOCK_SHINGLES shingles."""
    own = left.groupBy("id").agg(F.max(F.struct("pw", "p")).alias("f"), F.max("n").alias("n"), F.first("component").alias("component"))
    own = own.select("id", "n", "component", F.col("f.p").alias("f"))
    parts = own.groupBy("f").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    block = F.concat_ws(":", F.col("f").cast("string"), F.pmod(F.xxhash64("id"), "parts").cast("string"))
    return reliable_checkpoint(own.join(parts, "f").select("id", "component", block.alias("block")))


def whole_list(column: pa.ChunkedArray) -> pa.Array:
    """A list column of one row that holds all values of a column."""
    values = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def block_links(ids_a, comp_a, sets_a, ids_b, comp_b, sets_b, percent: int):
    """Links (component, component) found between two blocks, enough of them to connect what is linked."""
    size_a, size_b = (np.array([len(s) for s in sets]) for sets in (sets_a, sets_b))
    shared = np.intersect1d(np.concatenate(sets_a), np.concatenate(sets_b))
    both = np.zeros((len(sets_a), len(sets_b)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at:at + COLUMNS]
        hot = []
        for sets in (sets_a, sets_b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
                place = np.searchsorted(part, own)
                m[i, place[part[place] == own]] = 1
            hot.append(m)
        both += hot[0] @ hot[1].T
    near = (both > 0) & (100 * both >= percent * (size_a[:, None] + size_b[None, :] - both))
    root: dict = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = top(comp_a[i]), top(comp_b[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            yield min(x, y), max(x, y)


def rest_links(docs: DataFrame, left: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links between the components of open members: blocks that meet in a bucket are compared as wholes."""
    kind = docs.schema[id_col].dataType.simpleString()
    placed = in_blocks(left)
    met = left.select("key", "id").join(placed, "id").groupBy("key", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    other = met.select("key", F.col("block").alias("block_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = met.withColumnRenamed("block", "block_a").join(other, "key").where(
        (F.col("block_a") <= F.col("block_b")) & (F.least("lo", "lo_b") != F.greatest("hi", "hi_b")))
    pairs = pairs.select("block_a", "block_b").distinct()

    sets = sets_of(docs, placed.select(F.col("id").alias("_c")), placed.count(), words, id_col, text_col)
    rows = sets.join(placed, "id").select("block", "id", "component", "s")

    def gather(key, table):
        # The columns become one list each, without a copy in Python.
        return pa.table({"block": table.column("block").slice(0, 1), **{k: whole_list(table.column(k)) for k in ("id", "component", "s")}})

    packed = reliable_checkpoint(rows.groupBy("block").applyInArrow(
        gather, f"block string, id array<{kind}>, component array<{kind}>, s array<binary>"))

    def compare(batches):
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):  # one pair of blocks is held at a time; sets share the batch's memory
                sides = []
                for side in "ab":
                    sets = batch.column(at[f"s_{side}"])[k].values
                    sides += [batch.column(at[f"id_{side}"])[k].as_py(), batch.column(at[f"component_{side}"])[k].as_py(),
                              [np.frombuffer(v.as_buffer(), np.uint64) for v in sets]]
                got = list(block_links(*sides, percent))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field("id_a").type.value_type)
                                                      for c in zip(*got, strict=True)], names=["a", "b"])
            release_memory()

    sides = [packed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "id", "component", "s")]) for s in "ab"]
    found = pairs.join(sides[0], "block_a").join(sides[1], "block_b")
    found = found.select(*[f"{c}_{s}" for s in "ab" for c in ("id", "component", "s")])
    return found.mapInArrow(compare, f"a {kind}, b {kind}")


def link_components(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the class representatives that link with another."""
    buckets = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    weight = F.sum("c").over(Window.partitionBy("id"))  # at most BANDS rows of each class
    members = reliable_checkpoint(buckets.join(shared, "key").select("key", "id", "n", weight.alias("weight")))
    pivots = members.groupBy("key").agg(F.max(F.struct("weight", "id", "n")).alias("z"))
    pivots = pivots.select("key", F.col("z.weight").alias("pw"), F.col("z.id").alias("p"), F.col("z.n").alias("m"))
    members = reliable_checkpoint(members.join(pivots, "key").drop("weight"))
    stars = members.where((F.col("id") != F.col("p")) & comparable(percent))
    stars = reliable_checkpoint(stars.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
    found = components(confirm(docs, stars, words, percent, id_col, text_col))
    left = still_open(members, found)
    return merged(found, rest_links(docs, left, words, percent, id_col, text_col))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable), kept."""
    seen = reliable_checkpoint(sketches(docs, words, id_col, text_col))
    own = ["n_shingles", "x", "y"]
    full = seen.where("n_shingles > 0")
    classes = full.groupBy(*own).agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = reliable_checkpoint(classes)
    found = link_components(docs, classes.where("id is not null"), words, percent, id_col, text_col)
    named = classes.drop("bands").join(found, F.col("id") == F.col("node"), "left")
    named = named.select(*own, F.coalesce("component", "id").alias("component_id"))
    linked = full.drop("bands").join(named, own).select("id", "n_shingles", "component_id")
    alone = seen.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns kept; rows with a null id stay.

    Where ids repeat, each distinct text of an id is a node of its own, so a
    row goes only for what its own text is like.
    """
    found = reliable_checkpoint(near_duplicates(docs, words, percent, id_col, text_col))
    rows, ids = found.where(F.col(id_col).isNotNull()).agg(F.count(F.lit(1)), F.countDistinct(id_col)).first()
    if rows == ids:
        return without(docs, found, id_col)
    node = free_name(docs, "_node")
    told = text_nodes(docs, node, id_col, text_col)
    left = without(told, reliable_checkpoint(near_duplicates(told, words, percent, node, text_col)), node)
    left = left.where(F.col(node).isNotNull()).dropDuplicates([node]).unionByName(left.where(F.col(node).isNull()))
    return left.select(*docs.columns)


def without(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is kept or null."""
    gone_id = free_name(docs, "_gone")
    gone = found.where("kept = false").select(F.col(id_col).alias(gone_id)).distinct()
    gone, _ = broadcast_if_bounded(gone, MAX_BROADCAST_IDS)
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")


def text_nodes(docs: DataFrame, node: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` (checkpointed) with a number for each distinct (id, text), in the order of the ids; null for a null id."""
    said, own_id, own_said = (free_name(docs, c) for c in ("_said", "_own_id", "_own_said"))
    told = docs.withColumn(said, F.md5(group_key(F.col(text_col))))
    nodes = told.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(own_id), F.col(said).alias(own_said)).distinct()
    nodes = add_row_id(nodes, node, [own_id, own_said]).withColumn(node, F.col(node).cast("bigint"))
    same = (F.col(id_col) == F.col(own_id)) & (F.col(said) == F.col(own_said))
    return reliable_checkpoint(told.join(nodes, same, "left").select(*docs.columns, node))

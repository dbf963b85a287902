"""Operator 12: hard negatives by matrix products in a residue number system.

Vectors become integers floor(scale * x).  A block of scores is one float32
matrix product per prime p < 1024 on residues in (-p/2, p/2): with at most
``STEP`` dimensions at a time every partial sum stays below 2**24 and is exact.
As many primes are used as the block's largest possible score needs; the
signed scores come back by Chinese remaindering in mixed radix, exact for
every long.

Anchors and all rows meet on a grid of (strip of rows, group of anchors); both
sides of a grid cell have a bounded size, so hot labels, ids or vectors do not
gather anywhere.  The grid is used twice: first every anchor finds its best
rows of the same label (the positives), then, for the score window of each
positive, the best rows of other labels.  Each cell hands on only its best per
anchor or window; a ranking over the strips picks the final ones.

Cases: rows with a null id, a null label, a null or empty vector or any null
or non-finite component take no part; vectors of another length than the
anchor's are not compared with it; an anchor's other rows are those of another
id; an id in several rows is asked once (its largest label, then vector), but
each of its rows can be a positive or a negative; ties go to the smaller id;
a negative positive score has an empty window; no rows give no rows; extra
columns are ignored.  Scores that do not fit into a long raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardinal.llm.common import reliable_checkpoint
from cardinal.llm.vectors import finite, matrix

STEP = 64  # dimensions of one exact product: 64 * 511 ** 2 < 2 ** 24
STRIP_ROWS, GROUP_ANCHORS, PACK_ROWS = 65_536, 16_384, 4_096
ANCHORS_AT_ONCE = 128
LONG = 1 << 63


def primes_below(most: int, count: int) -> list[int]:
    found: list[int] = []
    n = most
    while len(found) < count:
        n -= 1
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
    return found


PRIMES = primes_below(1024, 7)  # their product passes 2 ** 65: any long has its residues


class Residues:
    """Integer-valued doubles as residues modulo each prime, made when first needed."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.made = whole, {}

    def of(self, p: int) -> np.ndarray:
        if p not in self.made:
            r = np.fmod(self.whole, p)
            r -= p * np.round(r / p)
            self.made[p] = r.astype(np.float32)
        return self.made[p]


def primes_for(bound: float) -> int:
    """How many primes hold every integer from -bound to bound."""
    if not bound < LONG:
        raise ValueError("scores of this size do not fit into a long")
    product, k = PRIMES[0], 1
    while product <= 2 * int(bound) + 3:
        product, k = product * PRIMES[k], k + 1
    return k


def product_modulo(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """left @ right.T modulo p, from 0 to p - 1, in float32."""
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, left.shape[1], STEP):
        part = left[:, at:at + STEP] @ right[:, at:at + STEP].T
        part -= p * np.floor(part * np.float32(1 / p))  # within rounding of [0, p): exact, may be off by one p
        total += part
        if at:
            total -= p * np.floor(total * np.float32(1 / p))
    total[total < 0] += p
    total[total >= p] -= p
    return total


def exact_scores(left: Residues, right: Residues, bound: float) -> np.ndarray:
    """All inner products of two sets of integer vectors as longs."""
    used = PRIMES[:primes_for(bound)]
    digits: list[np.ndarray] = []  # mixed radix: value = d0 + d1 p0 + d2 p0 p1 + ...
    for k, p in enumerate(used):
        digit = product_modulo(left.of(p), right.of(p), p)
        for j, q in enumerate(used[:k]):  # products stay below 2 ** 21: exact in float32
            digit -= digits[j]
            digit *= np.float32(pow(q, -1, p))
            digit -= p * np.floor(digit * np.float32(1 / p))
            digit[digit < 0] += p
            digit[digit >= p] -= p
        digits.append(digit)
    value = np.zeros(digits[0].shape, np.uint64)
    product = 1
    for p, digit in zip(used, digits, strict=True):
        value += digit.astype(np.uint64) * np.uint64(product % (1 << 64))
        product *= p
    # The upper half of the range stands for negative values; the highest digits tell.
    half, above, equal = (product - 1) // 2, np.zeros(value.shape, bool), np.ones(value.shape, bool)
    places = []
    for p in used:
        half, digit = divmod(half, p)
        places.append(digit)
    for digit, limit in zip(reversed(digits), reversed(places), strict=True):
        above |= equal & (digit > limit)
        equal &= digit == limit
        if not equal.any():
            break
    value[above] -= np.uint64(product % (1 << 64))
    return value.view(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of the places ``at`` with the highest scores, ties to the smaller id, best first."""
    if len(at) > 4 * k:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def packs(rows: DataFrame, scale: float) -> DataFrame:
    """Rows (id, label, v) as packs of at most PACK_ROWS: width, n, ids, labels, data (floor(scale * x) as doubles)."""

    def run(batches):
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                part = b.filter(pa.array(sizes == width))
                for at in range(0, part.num_rows, PACK_ROWS):
                    cut = part.slice(at, PACK_ROWS)
                    data = np.floor(scale * matrix(cut.column(2), int(width)))
                    if not np.isfinite(data).all():
                        raise ValueError("scores of this size do not fit into a long")
                    small = np.abs(data).max(initial=0) < 1 << 24
                    numbers = [pa.ListArray.from_arrays(pa.array([0, cut.num_rows], pa.int32()), cut.column(k)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.array([cut.num_rows], pa.int32()),
                         *numbers, pa.array([data.astype("<f4" if small else "<f8").tobytes()], pa.binary())],
                        names=["width", "n", "ids", "labels", "data"])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "width int, n int, ids array<bigint>, labels array<bigint>, data binary")


def unpack(table: pa.Table):
    """Yield (ids, labels, vectors) of each pack."""
    for k in range(table.num_rows):
        n, width = table.column("n")[k].as_py(), table.column("width")[k].as_py()
        ids, labels = (table.column(c)[k].values.to_numpy() for c in ("ids", "labels"))
        raw = table.column("data")[k].as_py()
        data = np.frombuffer(raw, "<f4" if len(raw) == 4 * n * width else "<f8").astype(np.float64)
        yield ids, labels, data.reshape(n, width)


def grid_cells(rows: pa.Table, anchors: pa.Table):
    """Yield (anchor ids, anchor labels, row ids, row labels, scores) for a strip against ANCHORS_AT_ONCE anchors at a time."""
    asked = list(unpack(anchors))
    for ids, labels, data in unpack(rows):
        right = Residues(data)
        largest = np.abs(data).max(axis=0, initial=0)
        for a_ids, a_labels, a_data in asked:
            for at in range(0, len(a_ids), ANCHORS_AT_ONCE):
                cut = slice(at, at + ANCHORS_AT_ONCE)
                left = Residues(a_data[cut])
                # A bound for every pair; only if it fails the sums of magnitudes themselves.
                bound = float((np.abs(left.whole) @ largest).max(initial=0)) * (1 + 1e-9)
                if not bound < LONG:
                    bound = float((np.abs(left.whole) @ np.abs(data).T).max(initial=0)) * (1 + 1e-9)
                yield a_ids[cut], a_labels[cut], ids, labels, exact_scores(left, right, bound)


def as_table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [()] * len(names))]
    return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(names, columns, strict=True)})


class Best:
    """The best rows so far for every key, over the packs of a strip."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, key, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            if key in self.held:
                ids, scores = (np.concatenate(x) for x in zip(self.held[key], (ids, scores), strict=True))
            top = best(ids, scores, np.arange(len(ids)), self.k)
            self.held[key] = ids[top], scores[top]


def positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """Of one cell: each anchor's k best rows of its own label."""
    kept = Best(k)
    for a_ids, a_labels, ids, labels, scores in grid_cells(rows, anchors):
        for i, (anchor, label) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), strict=True)):
            at = best(ids, scores[i], np.flatnonzero((labels == label) & (ids != anchor)), k)
            kept.add(anchor, ids[at], scores[i][at])
    return as_table([(np.full(len(i), a), i, s) for a, (i, s) in kept.held.items()], ["anchor_id", "positive_id", "positive_score"])


def negatives(rows: pa.Table, anchors: pa.Table, windows: pa.Table, k: int) -> pa.Table:
    """Of one cell: for each window of each anchor, the k best rows of other labels inside."""
    asked: dict[int, list[tuple[int, int, int]]] = {}
    for a, z, lo, hi in zip(*(windows.column(c).to_pylist() for c in ("anchor_id", "place", "lo", "hi")), strict=True):
        asked.setdefault(a, []).append((z, lo, hi))
    kept = Best(k)
    for a_ids, a_labels, ids, labels, scores in grid_cells(rows, anchors):
        for i, (anchor, label) in enumerate(zip(a_ids.tolist(), a_labels.tolist(), strict=True)):
            own = asked.get(anchor)
            if not own:
                continue
            row = scores[i]
            others = np.flatnonzero((labels != label) & (ids != anchor)
                                    & (row >= min(w[1] for w in own)) & (row <= max(w[2] for w in own)))
            for z, lo, hi in own:
                at = best(ids, row, others[(row[others] >= lo) & (row[others] <= hi)], k)
                kept.add((anchor, z), ids[at], row[at])
    return as_table([(np.full(len(i), a), np.full(len(i), z), i, s) for (a, z), (i, s) in kept.held.items()],
                    ["anchor_id", "place", "negative_id", "negative_score"])


def mine(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 10, scale: float = 256.0,
         window: tuple[int, int] = (30, 90), id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative lies in the window of a positive if low * positive score <=
    100 * negative score <= high * positive score.
    """
    low, high = window
    usable = vectors.where(finite(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    usable = usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                           F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    packed = reliable_checkpoint(packs(usable.select("id", "label", "v"), scale))
    asked = usable.where("asks").groupBy("id").agg(F.max(F.struct("label", "v")).alias("z"))
    asked = reliable_checkpoint(packs(asked.select("id", "z.label", "z.v"), scale))
    n, m = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (packed, asked))
    # Enough strips for the cores on small tables, strips of bounded size on large ones.
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    strips = max(1, -(-n // STRIP_ROWS), min(-(-n // PACK_ROWS), 2 * cores))
    groups = max(1, -(-m // GROUP_ANCHORS))

    def dealt(parts: int) -> Column:
        """A part from 0 by the number of the pack; an int on both sides, as cogroup does not align key types."""
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")

    per_strip = F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip")
    per_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    cell = ["width", "strip", "grp"]
    left = packed.withColumn("strip", dealt(strips)).select("*", per_group)
    anchors = asked.withColumn("grp", dealt(groups))
    of_anchor = anchors.select("grp", "ids", "width")

    def first_pass(_, rows: pa.Table, other: pa.Table) -> pa.Table:
        return positives(rows, other, k_positive)

    def second_pass(_, rows: pa.Table, other: pa.Table) -> pa.Table:
        plain = other.filter(other.column("n").is_valid())
        return negatives(rows, plain, other.filter(other.column("n").is_null()), k_negative)

    right = anchors.select("*", per_strip)
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        first_pass, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k_positive)
    score = F.col("positive_score").cast("decimal(38,0)")
    found = reliable_checkpoint(found.withColumns({
        "lo": F.ceil(score * low / 100).cast("bigint"), "hi": F.floor(score * high / 100).cast("bigint")}))

    where = of_anchor.select("grp", "width", F.explode("ids").alias("anchor_id"))
    asks = found.where("lo <= hi").join(where, "anchor_id").select("width", "grp", "anchor_id", "place", "lo", "hi")
    both = anchors.unionByName(asks, allowMissingColumns=True).select("*", per_strip)
    mined = left.groupBy(*cell).cogroup(both.groupBy(*cell)).applyInArrow(
        second_pass, "anchor_id bigint, place bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_negative)
    return mined.join(found, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

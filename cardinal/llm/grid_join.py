"""Operator 8: near-duplicate vectors by an epsilon grid order join.

Cosine >= t between vectors means a distance of at most eps = sqrt(2 - 2 t)
between their unit vectors.  These are projected on a few leading principal
directions (of a bounded sample; any directions are right, good ones are
fast), put on a grid of eps-wide cells, and sorted by cell within their group
(equal label, equal length).  The sorted sequence is cut into blocks.

Blocks meet only if their boxes in the projection are at most eps apart: a
join on the group and the cell slabs of the first direction, then the boxes.
Inside a pair of blocks the sequences are joined recursively: intervals whose
boxes are provably apart are skipped, the larger one is halved, and small ones
are compared by cosine in double precision.

Equal vectors of a group form one class with a weight first, so copies cost
nothing.  A pair of blocks reports, for each class with a link, the weight it
is linked to and one class of its local component: rows in proportion to the
blocks, never the pairs.  Components come from those reports.

Cases: rows with a null label, and vectors that are null, empty, zero, or hold
null or non-finite components, link with nothing (their component is their own
id); rows that repeat an id are separate vectors; rows with a null id are
counted as link partners and never kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import components, group_key, reliable_checkpoint
from cardinal.llm.vectors import finite, matrix

BLOCK_ROWS, LEAF_ROWS = 1024, 256
DIRECTIONS = 4
SAMPLE = 20_000
SLACK = 1e-9


def directions(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each vector length, leading principal directions of a bounded sample, as columns."""
    rate = min(1.0, SAMPLE / max(n, 1))
    draw = (F.xxhash64("v") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    by: dict[int, list] = {}
    for r in vectors.where(draw < rate).select("v").collect():
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for width, rows in by.items():
        x = unit(np.asarray(rows, np.float64))
        out[width] = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:DIRECTIONS].T
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows whose squares would vanish or overflow are scaled by their largest entry first."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((top < 1e-140) | (top > 1e140), x / top, x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def project(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors on the directions, padded to DIRECTIONS columns (zero where there is no direction)."""
    out = np.zeros((len(x), DIRECTIONS))
    if x.shape[1] in axes:
        got = unit(x) @ axes[x.shape[1]]
        out[:, :got.shape[1]] = got
    return out


class PairJoin:
    """Joins two blocks (or one with itself): link weights and local components."""

    def __init__(self, a, b, same: bool, threshold: float, eps: float):
        self.a, self.b, self.same, self.t, self.eps = a, b, same, threshold, eps
        (self.ua, self.pa, self.wa), (self.ub, self.pb, self.wb) = a, b
        self.links_a, self.links_b = np.zeros(len(self.wa), np.int64), np.zeros(len(self.wb), np.int64)
        self.root = np.arange(len(self.wa) + (0 if same else len(self.wb)))
        self.shift = 0 if same else len(self.wa)

    def apart(self, i, j, k, m) -> bool:
        p, q = self.pa[i:j], self.pb[k:m]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        return float(gap @ gap) > (self.eps + SLACK) ** 2

    def run(self):
        work = [(0, len(self.wa), 0, len(self.wb))]
        while work:
            i, j, k, m = work.pop()
            if i >= j or k >= m or (self.same and m <= i) or self.apart(i, j, k, m):
                continue
            if j - i <= LEAF_ROWS and m - k <= LEAF_ROWS:
                self.leaf(i, j, k, m)
            elif j - i >= m - k:
                mid = (i + j) // 2
                work += [(i, mid, k, m), (mid, j, k, m)]
            else:
                mid = (k + m) // 2
                work += [(i, j, k, mid), (i, j, mid, m)]
        return self

    def leaf(self, i, j, k, m):
        hit = self.ua[i:j] @ self.ub[k:m].T >= self.t
        if self.same:  # each unordered pair once: places of the left below those of the right
            hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if not hit.any():
            return
        self.links_a[i:j] += hit @ self.wb[k:m]
        (self.links_a if self.same else self.links_b)[k:m] += hit.T @ self.wa[i:j]
        rows, cols = np.nonzero(hit)
        self.union(rows + i, cols + k + self.shift)

    def union(self, x, y):
        root = self.root
        while True:
            rx, ry = root[x], root[y]
            if (rx == ry).all():
                return
            low = np.minimum(rx, ry)
            np.minimum.at(root, rx, low)
            np.minimum.at(root, ry, low)
            while (root != root[root]).any():
                root[:] = root[root]


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    nonzero = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                          group_key(F.col(label_col)).alias("g"), F.col(label_col).isNotNull().alias("labelled"))
    usable = rows.withColumn("ok", F.col("labelled") & finite("v")).withColumn("ok", F.col("ok") & F.coalesce(nonzero, F.lit(False)))
    classes = usable.where("ok").groupBy("g", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    classes = reliable_checkpoint(classes.withColumn("c", F.xxhash64("g", "v")))
    n = classes.count()
    axes = directions(classes, n)

    def place(batches):
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                part = b.filter(pa.array(sizes == width))
                p = project(matrix(part.column(2), int(width)), axes)
                cells = np.floor(p / max(eps, 1e-6)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(part.num_rows, width, np.int32)),
                     *[pa.array(cells[:, d]) for d in range(DIRECTIONS)]],
                    names=[*part.schema.names, "width", *[f"c{d}" for d in range(DIRECTIONS)]])

    cols = [f"c{d}" for d in range(DIRECTIONS)]
    placed = classes.select("c", "g", "v", "w").mapInArrow(
        place, "c bigint, g string, v array<double>, w bigint, width int, " + ", ".join(f"{c} bigint" for c in cols))
    order = ["g", "width", *cols, "c"]
    parts = max(1, -(-n // (2 * BLOCK_ROWS)))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches):
        for b in batches:
            g, width = b.column(1).to_pylist(), b.column(4).to_pylist()
            at = 0
            while at < len(g):
                end = at
                while end < len(g) and end - at < BLOCK_ROWS and g[end] == g[at] and width[end] == width[at]:
                    end += 1
                part = b.slice(at, end - at)
                x = matrix(part.column(2), width[at])
                p = project(x, axes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[at]]), pa.array([width[at]], pa.int32()), pa.array([p.min(axis=0).tolist()]),
                     pa.array([p.max(axis=0).tolist()]),
                     *[pa.array([np.asarray(part.column(i).to_numpy(zero_copy_only=False), "<i8").tobytes()], pa.binary())
                       for i in (0, 3)],
                     pa.array([x.astype("<f8").tobytes()], pa.binary())],
                    names=["g", "width", "lo", "hi", "ids", "ws", "xs"])
                at = end

    blocks = ordered.mapInArrow(cut, "g string, width int, lo array<double>, hi array<double>, ids binary, ws binary, xs binary")
    blocks = reliable_checkpoint(blocks.withColumn("block", F.monotonically_increasing_id()))

    step = max(eps, 1e-6)
    slab = blocks.select("block", "g", "width", "lo", "hi",
                         F.floor(F.col("lo")[0] / step).alias("s0"), F.floor(F.col("hi")[0] / step).alias("s1"))
    left = slab.select(*[F.col(c).alias(f"a_{c}") for c in ("block", "lo", "hi")], "g", "width",
                       F.explode(F.sequence(F.col("s0") - 1, F.col("s1") + 1)).alias("s"))
    right = slab.select(*[F.col(c).alias(f"b_{c}") for c in ("block", "lo", "hi")], "g", "width",
                        F.explode(F.sequence("s0", "s1")).alias("s"))
    gap = F.expr("aggregate(zip_with(zip_with(a_lo, b_hi, (p, q) -> greatest(0D, p - q)), zip_with(b_lo, a_hi, (p, q) -> "
                 "greatest(0D, p - q)), (p, q) -> greatest(p, q) * greatest(p, q)), 0D, (s, x) -> s + x)")
    pairs = left.join(right, ["g", "width", "s"]).where(F.col("a_block") <= F.col("b_block"))
    pairs = pairs.where(gap <= (eps + SLACK) ** 2).select("a_block", "b_block").distinct()
    data = blocks.select("block", "width", "ids", "ws", "xs")
    met = (pairs.join(data.select(F.col("block").alias("a_block"), "width", *[F.col(c).alias(f"a_{c}") for c in ("ids", "ws", "xs")]), "a_block")
           .join(data.select(F.col("block").alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in ("ids", "ws", "xs")]), "b_block"))

    def load(row, side):
        x = np.frombuffer(row[f"{side}_xs"], "<f8").reshape(-1, row["width"])
        return (unit(x), project(x, axes), np.frombuffer(row[f"{side}_ws"], "<i8")), np.frombuffer(row[f"{side}_ids"], "<i8")

    def join(batches):
        for b in batches:
            for row in b.to_pylist():
                same = row["a_block"] == row["b_block"]
                a, ids_a = load(row, "a")
                got = PairJoin(a, a, True, threshold, eps) if same else None
                ids, ids_b = ids_a, ids_a[:0]
                if got is None:
                    other, ids_b = load(row, "b")
                    got = PairJoin(a, other, False, threshold, eps)
                    ids = np.concatenate((ids_a, ids_b))
                got.run()
                links = got.links_a if same else np.concatenate((got.links_a, got.links_b))
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[got.root[at]])],
                                                     names=["c", "links", "peer"])

    met = met.select("a_block", "b_block", "width", *[f"{s}_{c}" for s in "ab" for c in ("ids", "ws", "xs")])
    # Skewed joins come in many small splits; what follows needs no more tasks than any shuffle.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = reliable_checkpoint(met.mapInArrow(join, "c bigint, links bigint, peer bigint").coalesce(tasks))
    totals = found.groupBy("c").agg(F.sum("links").alias("links"))
    nodes = components(found.select(F.col("c").alias("a"), F.col("peer").alias("b")))
    named = (classes.select("c", "id", "w").join(nodes, F.col("c") == F.col("node"), "left")
             .withColumn("component", F.coalesce("component", "c")).drop("node"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    result = (named.join(lowest, "component").join(totals, "c", "left")
              .select("c", "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    linked = usable.where("ok").select("id", F.xxhash64("g", "v").alias("c")).join(result, "c").select("id", "n_links", "component_id")
    alone = usable.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

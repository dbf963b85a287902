"""Density-based clusters (K2, DBSCAN) on a graph of grid cells.

A point is a core point if at least ``min_neighbors`` other points lie within
``radius``; core points within ``radius`` of each other share a cluster, other
points within ``radius`` of a core point are its border, the rest is noise (0).
Pairs of points are never listed:

1. Equal points become one point with a count.  The space is cut into cells
   whose points are all neighbours of each other (side ``radius / d ** (1/p)``
   after weights are scaled into the coordinates).
2. The points of a cell lie in blocks of at most ``BLOCK`` points; the points
   of a large cell are ordered along a space-filling curve first, so its blocks
   are small boxes.  Cells meet the occupied cells within ``radius`` by an
   equi-join on a coarse grid, blocks meet by the distance of their boxes.
3. In a cell with more than ``min_neighbors`` points all are core points; the
   points of other cells count their neighbours block by block, one number per
   point and block.
4. The core points of a cell share a cluster, so clusters are components of
   cells.  Two cells are linked if one pair of core points is near: boxes that
   surely are, then the nearest pair of blocks, and the other pairs of near
   blocks only for cells that are still not linked.
5. A border point reports the clusters it touches, once per cell.

Clusters with fewer than ``min_cluster_size`` core and border points are
dropped; the others are numbered from 1 by their smallest core id.  A border
point goes to the cluster with the smallest number.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.distances import Dissimilarity
from cardinal.operators.graph import components
from cardinal.operators.ranking import N, RANK, RN, ordered_numbers
from cardinal.session import stored

BLOCK = 2048
COARSE_DIMS = 3  # dimensions of the grid on which cells look for each other: 27 neighbours at most
CURVE_BITS = 30


def exponent(dist: Dissimilarity) -> float:
    """p of the Minkowski distance that a true metric is after its weights are scaled into the coordinates."""
    if not dist.is_metric:
        raise ValueError(f"dbscan needs a true metric, not {dist.type!r}")
    if dist.type == "chebyshev":
        return float("inf")
    return {"euclidean": 2.0, "cityblock": 1.0}.get(dist.type.removeprefix("weighted_"), float(dist.p))


def norm(gaps: Column, p: float) -> Column:
    """The p-norm of an array of non-negative numbers."""
    if p == float("inf"):
        return F.array_max(gaps)
    total = F.aggregate(F.transform(gaps, lambda g: g * g if p == 2 else g if p == 1 else F.pow(g, F.lit(p))), F.lit(0.0), lambda a, b: a + b)
    return total if p == 1 else F.sqrt(total) if p == 2 else F.pow(total, F.lit(1 / p))


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """All distances of two small sets of points."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = np.abs(a[:, k, None] - b[None, :, k])
        if p == float("inf"):
            np.maximum(total, gap, out=total)
        else:
            total += gap * gap if p == 2 else gap if p == 1 else gap**p
    return total if p in (1.0, float("inf")) else np.sqrt(total) if p == 2 else total ** (1 / p)


def rows_of(batch: pa.RecordBatch, names: list[str]):
    """The list columns of a batch, row by row, as arrays that share its memory."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for k in range(batch.num_rows):
        yield k, [c[k].values.to_numpy(zero_copy_only=False) for c in columns]


def located(points: DataFrame, radius: float, dist: Dissimilarity) -> tuple[DataFrame, int, float, float]:
    """Distinct points (x, id, w, y scaled, cell) and the dimension, the exponent and the side of a cell."""
    sizes = points.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"points have {sizes[0]} to {sizes[1]} coordinates")
    d, p = sizes[0] or 1, exponent(dist)
    side = radius / d ** (1 / p) * (1 - 1e-9)  # rounding cannot bring two points of a cell out of reach
    scale = dist._w(d) ** (1 / p)
    y = F.zip_with("x", F.array(*[F.lit(float(s)) for s in scale]), lambda v, s: v * s)
    pts = points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).withColumn("y", y)
    pts = pts.withColumn("cell", F.transform("y", lambda v: F.floor(v / side).cast("bigint")))
    return stored(pts), d, p, side


def with_blocks(pts: DataFrame, d: int, side: float) -> DataFrame:
    """Add ``total`` (points of the cell), and ``block``: at most BLOCK points of a cell, close to each other."""
    cells = pts.groupBy("cell").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("k"))
    placed = pts.join(cells, "cell")
    large = placed.where(F.col("k") > BLOCK)
    small = placed.where(F.col("k") <= BLOCK).select("x", "id", "w", "y", "cell", "total", F.lit(0).cast("bigint").alias("block"))
    if cells.where(F.col("k") > BLOCK).isEmpty():
        return stored(small)
    bits = max(1, CURVE_BITS // d)
    part = [F.least(F.greatest(F.floor((F.col("y")[i] / side - F.col("cell")[i]) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1))
            for i in range(d)]
    curve = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, v in enumerate(part):
            if bit * d + i < 62:
                curve = curve + F.shiftleft(F.shiftright(v.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint")), bit * d + i)
    ranked = ordered_numbers(large.withColumn("_z", curve), ["_z"], ["cell"], tiebreak=["id"])
    ranked = ranked.withColumn("block", F.floor((F.col(RN) - 1) / BLOCK).cast("bigint")).drop(RN, RANK, N, "_z")
    return stored(small.unionByName(ranked.select(*small.columns)))


def gathered(pts: DataFrame, d: int) -> DataFrame:
    """One row per block: its points (ids, weights, coordinates) and its box (lo, hi)."""
    one = F.struct("id", "w", "y")
    got = pts.groupBy("cell", "block").agg(
        F.collect_list(one).alias("p"), F.array(*[F.min(F.col("y")[i]) for i in range(d)]).alias("lo"),
        F.array(*[F.max(F.col("y")[i]) for i in range(d)]).alias("hi"))
    return stored(got.select(
        "cell", "block", "lo", "hi", F.transform("p", lambda q: q["id"]).alias("ids"),
        F.transform("p", lambda q: q["w"]).alias("ws"), F.flatten(F.transform("p", lambda q: q["y"])).alias("ys")))


def box_gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str, p: float) -> Column:
    """The least distance between two boxes."""
    below = F.zip_with(lo_a, hi_b, lambda a, b: a - b)
    above = F.zip_with(lo_b, hi_a, lambda a, b: a - b)
    return norm(F.zip_with(below, above, lambda a, b: F.greatest(a, b, F.lit(0.0))), p)


def box_span(lo_a: str, hi_a: str, lo_b: str, hi_b: str, p: float) -> Column:
    """The largest distance between points of two boxes."""
    one = F.zip_with(hi_a, lo_b, lambda a, b: a - b)
    two = F.zip_with(hi_b, lo_a, lambda a, b: a - b)
    return norm(F.zip_with(one, two, lambda a, b: F.greatest(a, b)), p)


def near_cells(cells: DataFrame, d: int, p: float, side: float, radius: float) -> DataFrame:
    """Ordered pairs (a, b) of different cells that can hold points within ``radius``."""
    step = int(np.ceil(radius / side))
    dims = min(d, COARSE_DIMS)
    coarse = [F.floor(F.col("cell")[i] / step).cast("bigint") for i in range(dims)]
    offsets = F.array(*[F.array(*[F.lit(o).cast("bigint") for o in offs]) for offs in product((-1, 0, 1), repeat=dims)])
    left = cells.select(F.col("cell").alias("a"), F.explode(offsets).alias("o"), F.array(*coarse).alias("k"))
    left = left.select("a", F.zip_with("k", "o", lambda k, o: k + o).alias("key"))
    right = cells.select(F.col("cell").alias("b"), F.array(*coarse).alias("key"))
    gap = F.zip_with("a", "b", lambda a, b: F.greatest(F.abs(a - b) - 1, F.lit(0)).cast("double") * side)
    met = left.join(right, "key").where((F.col("a") != F.col("b")) & (norm(gap, p) <= radius * (1 + 1e-9)))
    return stored(met.select("a", "b"))


def block_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, p: float, radius: float) -> DataFrame:
    """(a, block_a, b, block_b, gap, span) of the blocks of near cells whose boxes are near."""
    one, two = (x.select(F.col("cell").alias(s), F.col("block").alias(f"block_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))
                for x, s in ((left, "a"), (right, "b")))
    box = ("lo_a", "hi_a", "lo_b", "hi_b")
    met = pairs.join(one, "a").join(two, "b").withColumn("gap", box_gap(*box, p)).withColumn("span", box_span(*box, p))
    return met.where(F.col("gap") <= radius * (1 + 1e-9)).select("a", "block_a", "b", "block_b", "gap", "span")


def with_points(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of blocks with the points of both."""
    one, two = (x.select(F.col("cell").alias(s), F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"),
                         F.col("ws").alias(f"ws_{s}"), F.col("ys").alias(f"ys_{s}")) for x, s in ((left, "a"), (right, "b")))
    return pairs.join(one, ["a", "block_a"]).join(two, ["b", "block_b"])


def neighbour_counts(met: DataFrame, d: int, p: float, radius: float) -> DataFrame:
    """(id, n): points of other cells within reach of the points of the left blocks, one row per point and block."""

    def run(batches):
        for batch in batches:
            for _, (ids, ya, wb, yb) in rows_of(batch, ["ids_a", "ys_a", "ws_b", "ys_b"]):
                n = (distances(ya.reshape(-1, d), yb.reshape(-1, d), p) <= radius) @ wb.astype(np.float64)
                hit = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit].astype(np.int64))], names=["id", "n"])

    return met.select("ids_a", "ys_a", "ws_b", "ys_b").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def linked_cells(met: DataFrame, d: int, p: float, radius: float) -> DataFrame:
    """The cell pairs (a, b) of which a pair of blocks holds points within reach."""

    def run(batches):
        for batch in batches:
            good = [bool((distances(ya.reshape(-1, d), yb.reshape(-1, d), p) <= radius).any())
                    for _, (ya, yb) in rows_of(batch, ["ys_a", "ys_b"])]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return met.select("a", "b", "ys_a", "ys_b").mapInArrow(run, "a array<bigint>, b array<bigint>").distinct()


def touched(met: DataFrame, d: int, p: float, radius: float) -> DataFrame:
    """(id, cluster) of the points of left blocks within reach of a core point, one row per point and block."""

    def run(batches):
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("cluster"))
            for k, (ids, ya, yb) in rows_of(batch, ["ids_a", "ys_a", "ys_b"]):
                hit = (distances(ya.reshape(-1, d), yb.reshape(-1, d), p) <= radius).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(np.full(int(hit.sum()), names[k].as_py()), pa.int64())],
                                                 names=["id", "cluster"])

    return met.select("ids_a", "ys_a", "ys_b", "cluster").mapInArrow(run, "id bigint, cluster bigint")


def dbscan_points(points: DataFrame, radius: float, min_neighbors: int = 1, min_cluster_size: int = 1,
                  dist: Dissimilarity = Dissimilarity("euclidean")) -> DataFrame:
    """(x, label) of the distinct points of ``points`` (id bigint, x array of finite doubles); 0 is noise."""
    pts, d, p, side = located(points, radius, dist)
    pts = with_blocks(pts, d, side)
    cells = stored(pts.select("cell", "total").distinct())
    pairs = near_cells(cells, d, p, side, radius)
    blocks = gathered(pts, d)

    # Core points: whole cells, or by counting over the near cells.
    dense = F.col("total") > min_neighbors
    sparse = cells.where(~dense).select(F.col("cell").alias("a"))
    met = with_points(block_pairs(pairs.join(sparse, "a"), blocks, blocks, p, radius), blocks, blocks)
    counts = neighbour_counts(met, d, p, radius)
    pts = pts.join(counts, "id", "left")
    pts = stored(pts.withColumn("core", dense | (F.col("total") - 1 + F.coalesce("n", F.lit(0)) >= min_neighbors)).drop("n"))

    # Clusters of core cells, named by the smallest core id.
    core = pts.where("core")
    core_cells = stored(core.groupBy("cell").agg(F.min("id").alias("rep"), F.sum("w").alias("w")))
    core_blocks = gathered(core, d)
    name_a, name_b = (core_cells.select(F.col("cell").alias(s), F.col("rep").alias(f"rep_{s}")) for s in "ab")
    half = pairs.join(name_a, "a").join(name_b, "b").where("rep_a < rep_b")
    near = stored(block_pairs(half.select("a", "b"), core_blocks, core_blocks, p, radius))
    sure = near.where(F.col("span") <= radius * (1 - 1e-9)).select("a", "b").distinct()
    open_ = near.join(sure, ["a", "b"], "left_anti")
    first = open_.groupBy("a", "b").agg(F.min(F.struct("gap", "block_a", "block_b")).alias("z"))
    first = first.select("a", "b", "z.block_a", "z.block_b")
    hit = stored(sure.union(linked_cells(with_points(first, core_blocks, core_blocks), d, p, radius)))
    rest = open_.join(hit, ["a", "b"], "left_anti").join(first, ["a", "b", "block_a", "block_b"], "left_anti")
    links = hit.union(linked_cells(with_points(rest, core_blocks, core_blocks), d, p, radius))
    named = components(links.join(name_a, "a").join(name_b, "b"), "rep_a", "rep_b")
    core_cells = core_cells.join(named, F.col("rep") == F.col("node"), "left")
    core_cells = stored(core_cells.select("cell", "w", F.coalesce("component", "rep").alias("cluster")))

    # Border points: the clusters in reach.
    edge = pts.where("not core")
    edge_blocks = gathered(edge, d)
    cluster_b = core_cells.select(F.col("cell").alias("b"), "cluster")
    own = edge.join(core_cells.select("cell", "cluster"), "cell").select("id", "cluster")
    met = with_points(block_pairs(pairs.join(cluster_b.select("b"), "b"), edge_blocks, core_blocks, p, radius), edge_blocks, core_blocks)
    border = stored(own.union(touched(met.join(cluster_b, "b"), d, p, radius)).distinct())

    sizes = core_cells.select("cluster", "w").union(border.join(edge.select("id", "w"), "id").select("cluster", "w"))
    sizes = sizes.groupBy("cluster").agg(F.sum("w").alias("size")).where(F.col("size") >= min_cluster_size)
    kept = ordered_numbers(sizes, ["cluster"]).select("cluster", F.col(RN).alias("label"))
    kept = stored(kept)
    of_core = core.join(core_cells.select("cell", "cluster"), "cell").join(kept, "cluster", "left").select("x", "label")
    of_edge = border.join(kept, "cluster").groupBy("id").agg(F.min("label").alias("label"))
    of_edge = edge.join(of_edge, "id", "left").select("x", "label")
    return of_core.union(of_edge).select("x", F.coalesce("label", F.lit(0).cast("bigint")).alias("label"))

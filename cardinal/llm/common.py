"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cardinal.operators.ranking import plain_scan, scanned
from cardinal.session import checkpoint_dir, reliable_checkpoint

__all__ = ["arrow_map", "checkpoint_dir", "components", "fold", "free_name", "group_key", "in_order", "release_memory", "reliable_checkpoint",
           "seeded_ranks", "shuffle_key", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def group_key(col: Column) -> Column:
    """A never-null text form of a grouping value, so that null is one more group and equi-joins stay plain."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def in_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns that sort its rows in the order they came in, and the names of these.

    Rows of a Parquet scan come in the order of file and row; other rows in
    that of their partitions.
    """
    part, row = free_name(df, "_part"), free_name(df, "_row")
    if plain_scan(df) and scanned(df, "row_index"):
        got = df.select("*", F.col("_metadata.file_path").alias(part), F.col("_metadata.row_index").alias(row))
    else:
        got = df.select("*", F.lit("").alias(part), F.monotonically_increasing_id().alias(row))
    return got, [part, row]


def release_memory() -> None:
    """Give freed memory of a task back: workers live on for other stages, and an executor's share is bounded."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def arrow_map(df: DataFrame, fn, schema: str, rows: int = 2_000) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> record batch or None`` applied to every batch, ``rows`` rows at a time.

    What Python holds at once is bounded by the slice, and the Arrow pool gives
    back what a task has used (workers live on for other stages).
    """

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                got = fn(b.slice(at, rows))
                if got is not None:
                    yield got
        release_memory()

    return df.mapInArrow(run, schema)


def seeded_ranks(df: DataFrame, group: str, key: str, ties: Sequence[str], bits: int = 10) -> DataFrame:
    """Add ``rank`` (from 1) of each row in its ``group`` by the hash column ``key``, and ``group_rows``.

    ``key`` is a uniform 64-bit hash of the row's identity; its leading
    ``bits`` cut every group into 2**bits ordered buckets of like size, so a
    group with a third of all rows is numbered by 2**bits windows rather
    than one.  A row's rank is its number in its bucket plus the rows of the
    group's earlier buckets, from a pre-aggregated count table (groups x
    2**bits rows at most).  Only DataFrame functions; one shuffle of the
    rows, which the join with the counts reuses.
    """
    b = "_bucket"
    cut = df.withColumn(b, F.shiftright(F.col(key), 64 - bits))
    counts = cut.groupBy(b, group).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(group).orderBy(b)
    counts = counts.select(
        F.col(b).alias("_b2"), F.col(group).alias("_g2"),
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("group_rows"),
    )
    own = Window.partitionBy(b, group).orderBy(F.col(key), *[F.col(t).asc_nulls_last() for t in ties])
    numbered = cut.withColumn("_local", F.row_number().over(own))
    joined = numbered.join(counts, (F.col(b) == F.col("_b2")) & (F.col(group) == F.col("_g2")))
    return joined.withColumn("rank", F.col("_before") + F.col("_local")).drop(b, "_b2", "_g2", "_before", "_local")


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 200) -> DataFrame:
    """Connected components: (``node``, ``component`` = smallest node reachable), for nodes with an edge.

    Alternating large-star and small-star steps; both keep the components
    and never add edges, and they end with a star around each component's
    smallest node.  Every round is checkpointed in the shared folder and
    observed on the way, so that an unchanged round ends the loop.  Reaching
    ``max_rounds`` raises instead of returning a partial result.
    """
    cur = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    cur, state = observed(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Large star: every neighbour larger than the node points to the node's smallest neighbour.
        both = cur.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        both = both.select("e.u", "e.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # Small star: the node and its smaller neighbours point to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.col("u"), F.col("v"))).alias("u")
        small = large.join(low, "u").select(ends, F.col("m").alias("v")).where("u != v").distinct()
        # Pairs (node, smaller neighbour) only move down: an unchanged set is a fixed point.
        nxt, now = observed(small)
        if now == state:
            break
        cur, state = nxt, now
    else:
        raise RuntimeError("components did not settle")
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def observed(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs (u, v), checkpointed, with their number and the sum of their hashes."""
    seen = Observation()
    kept = reliable_checkpoint(pairs.observe(seen, F.count(F.lit(1)).alias("n"),
                                             F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    got = seen.get
    return kept, (got["n"], got["h"])


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A uniform non-negative 63-bit number of the parts and the seed: the first 60 bits of an MD5, times 8."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.shiftleft(F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long"), 3)

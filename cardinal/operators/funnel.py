"""Feature assembly, one-hot coding and fixed-size batches.

* Levels of a categorical column are the sorted distinct values of the
  training rows (a distributed ``distinct``; the level list is bounded and
  checked before it reaches the driver, since each level becomes a column).
* Batches are exact: ``batch = floor((row_number - 1) / batchsize)`` over
  the split's order, computed with the skew-safe ranking, so each batch is a
  group of at most ``batchsize`` rows - a proven bound for per-batch work in
  ``applyInPandas``.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import asc, join_names, qcol
from cardinal.operators.filters import split_rows, training_rows
from cardinal.operators.ranking import N, RANK, RN, ordered_cumsum, ordered_numbers

MAX_LEVELS = 10_000
BATCH = "_batch"
KEY_BITS = 60
BUCKET_ROWS = 50_000  # of a shuffled order are numbered in one task


def levels(df: DataFrame, column: str, partition: str | None = None) -> list:
    """Sorted distinct non-NULL values of ``column`` on the training rows."""
    d = training_rows(df, partition).select(qcol(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    n = d.count()
    if n > MAX_LEVELS:
        raise ValueError(f"{column!r} has {n} levels; too many to one-hot encode")
    return [r[0] for r in d.orderBy(asc("v")).collect()]


def onehot_names(column: str, lvls: Sequence) -> list[str]:
    return [join_names(column, lv) for lv in lvls]


def onehot(df: DataFrame, column: str, lvls: Sequence, names: Sequence[str] | None = None,
           strict: bool = True) -> DataFrame:
    """One 0/1 double column per level (N2); an unseen non-NULL level raises when ``strict``."""
    names = list(names or onehot_names(column, lvls))
    c = qcol(column)
    cols = [F.when(c == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)).alias(n) for lv, n in zip(lvls, names)]
    out = df.select("*", *cols)
    if strict and lvls:
        known = c.isNull() | c.isin(list(lvls))
        out = out.select(*[qcol(x) for x in df.columns],
                         *[F.when(known, qcol(n)).otherwise(F.raise_error(F.concat(
                             F.lit(f"unseen level in {column}: "), c.cast("string")))).alias(n) for n in names])
    return out


def onehot_decode(cols: Sequence[Column], lvls: Sequence) -> Column:
    """Label of the largest entry of a one-hot/score block."""
    arr = F.array(*[c.cast("double") for c in cols])
    labels = F.array(*[F.lit(lv) for lv in lvls])
    return F.element_at(labels, F.array_position(arr, F.array_max(arr)).cast("int"))


def assemble(cols: Sequence[str]) -> Column:
    """Named inputs as one float array in config order."""
    return F.array(*[qcol(c).cast("float") for c in cols])


def with_batches(df: DataFrame, order_by: Sequence[str], batchsize: int, tiebreak: Sequence[str] | None = None,
                 shuffle_seed: int | None = None) -> DataFrame:
    """Add ``_batch`` (0-based) to every row: fixed-size batches in order.

    With ``shuffle_seed`` the order is random (:func:`shuffled_batches`).
    """
    if batchsize < 1:
        raise ValueError("batchsize must be >= 1")
    if shuffle_seed is not None:
        return shuffled_batches(df, list(tiebreak or order_by), batchsize, shuffle_seed)
    num = ordered_numbers(df, list(order_by), (), tiebreak=list(tiebreak or order_by))
    return num.withColumn(BATCH, F.floor((F.col(RN) - 1) / F.lit(int(batchsize))).cast("bigint")).drop(RN, RANK, N)


def permutation_key(ids: Sequence[str], seed: int, epoch: int) -> Column:
    """A uniform 60-bit number of the row's id, the seed and the epoch (the head of an MD5: any engine can make it)."""
    said = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *[F.coalesce(qcol(c).cast("string"), F.lit("")) for c in ids])
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("bigint")


def shuffled_batches(df: DataFrame, id_cols: Sequence[str], batchsize: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """Add ``_batch`` (0-based): the rows in a random order, cut into batches of ``batchsize``, the last one shorter.

    The order is that of a keyed hash of the id, the seed and the epoch: a
    seed repeats it, another epoch or seed gives another one, and without a
    seed every call draws its own.  The leading bits of the uniform key cut
    the rows into ordered buckets of about ``BUCKET_ROWS`` rows; a row's place is its
    number in its bucket plus the rows of earlier buckets, from a table of
    one count per bucket.  So the rows are shuffled once, without sampling
    for ranges, a global ranking or a copy.  ``id_cols`` identify rows; rows
    that share an id share a place in the order and are numbered by their other columns.
    """
    if batchsize < 1:
        raise ValueError("batchsize must be >= 1")
    seed = secrets.randbelow(1 << 62) if seed is None else int(seed)
    bits = 0
    n = df.count()
    while n >> bits > BUCKET_ROWS:
        bits += 1
    key = permutation_key(id_cols, seed, epoch)
    bucket = F.shiftright(key, KEY_BITS - bits) if bits else F.lit(0).cast("bigint")
    counts = df.select(bucket.alias("_cd_b")).groupBy("_cd_b").agg(F.count(F.lit(1)).alias("_cd_n"))
    before = ordered_cumsum(counts, "_cd_b", "_cd_n", "_cd_before").drop("_cd_n")
    keyed = df.withColumns({"_cd_b": bucket, "_cd_key": key})
    rest = [asc(c) for c in df.columns if c not in id_cols and orderable(df.schema[c].dataType)]
    own = Window.partitionBy("_cd_b").orderBy("_cd_key", *[asc(c) for c in id_cols], *rest)
    placed = keyed.withColumn("_cd_place", F.row_number().over(own)).join(before, "_cd_b")
    batch = F.floor((F.col("_cd_before") + F.col("_cd_place") - 1) / F.lit(int(batchsize))).cast("bigint")
    return placed.select(*[qcol(c) for c in df.columns], batch.alias(BATCH))


def orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType)) and "map<" not in dtype.simpleString()


def batch_counts(df: DataFrame, partition: str | None, batchsize: int) -> dict:
    """Rows and batches per split (N19): ``ceil(rows / batchsize)``; split 2 is empty without a partition."""
    out = {}
    for i in (1, 2):
        n = split_rows(df, partition, i).count()
        out[i] = {"rows": n, "batches": -(-n // batchsize)}
    return out


def map_batches(df: DataFrame, fn: Callable, schema: str, batch_col: str = BATCH) -> DataFrame:
    """Apply a pandas function to each fixed-size batch (``applyInPandas``; groups are bounded by batchsize)."""
    return df.groupBy(qcol(batch_col)).applyInPandas(fn, schema)

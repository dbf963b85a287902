"""Joins used by cards.

* J1: left equi-join of a table to grouped statistics.  Zero keys turn the
  single statistics row into literals (no join at all).  With keys, the
  statistics side is broadcast only when its measured rows and bytes are below
  bounds; otherwise a shuffle join runs and AQE splits skewed keys.
* J3: "update join" of a keyed result table back into the main table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import qcol

# Largest table that may be broadcast, by rows and by measured bytes: far below executor memory.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 << 20
FIELD_BYTES = 16  # a field's fixed part in a hashed row, with its share of the row's overhead


def measured(small: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes they take: fixed parts by the schema, texts and nested values by their lengths."""
    lengths = []
    for field in small.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            lengths.append(F.octet_length(qcol(field.name)))
        elif kind in ("array", "map", "struct", "variant"):
            lengths.append(F.octet_length(F.to_json(F.struct(qcol(field.name)))))
    if not lengths:
        rows = small.count()
        return rows, rows * FIELD_BYTES * len(small.columns)
    long = [F.coalesce(F.sum(n.cast("long")), F.lit(0)) for n in lengths]
    got = small.agg(F.count(F.lit(1)), *long).first()
    return got[0], got[0] * FIELD_BYTES * len(small.columns) + sum(got[1:])


def broadcast_if_bounded(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                         max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast hint only after a count of its rows and bytes proves the table small.

    ``small`` should be materialised (checkpointed) so that the count and
    the join read the same rows.
    """
    rows, size = measured(small)
    return (F.broadcast(small), True) if rows <= max_rows and size <= max_bytes else (small, False)


def join_stats(df: DataFrame, stats: DataFrame | Mapping[str, object], keys: Sequence[str],
               prefix: str = "_st_") -> tuple[DataFrame, dict[str, Column]]:
    """Left-join statistics on ``keys`` (plain ``=``, NULL keys never match).

    Returns the joined frame and a mapping stat-name -> Column.  With no
    keys, ``stats`` is a dict of scalars and becomes literals.
    """
    if not keys:
        values = stats if isinstance(stats, Mapping) else stats.first().asDict()
        return df, {k: F.lit(v).cast("double") for k, v in values.items()}
    st_cols = [c for c in stats.columns if c not in keys]
    renamed = stats.select(
        *[qcol(k).alias(prefix + "k_" + k) for k in keys],
        *[qcol(c).alias(prefix + c) for c in st_cols],
    )
    side, _ = broadcast_if_bounded(renamed)
    cond = None
    for k in keys:
        c = qcol(k) == F.col(f"`{prefix}k_{k}`")
        cond = c if cond is None else cond & c
    joined = df.join(side, cond, "left")
    joined = joined.drop(*[f"{prefix}k_{k}" for k in keys])
    return joined, {c: F.col(f"`{prefix}{c}`") for c in st_cols}


def update_join(df: DataFrame, keyed: DataFrame, id_var: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Write ``keyed``'s columns into ``df`` by ``id_var``.

    New columns: value for matching ids, NULL otherwise.  Existing columns:
    value for matching ids, the old value kept otherwise.  ``keyed`` must be
    unique on ``id_var``; the join is a shuffle join on a unique key, so no
    key is hot.
    """
    columns = [c for c in (columns or keyed.columns) if c != id_var]
    tag = "_cd_match"
    right = keyed.select(
        qcol(id_var).alias("_cd_rid"), F.lit(True).alias(tag), *[qcol(c).alias(f"_cd_new_{c}") for c in columns]
    )
    joined = df.join(right, qcol(id_var) == F.col("_cd_rid"), "left")
    existing = set(df.columns)
    out = []
    for c in df.columns:
        if c in columns:
            out.append(F.when(F.col(tag).isNotNull(), F.col(f"`_cd_new_{c}`")).otherwise(qcol(c)).alias(c))
        else:
            out.append(qcol(c))
    for c in columns:
        if c not in existing:
            out.append(F.col(f"`_cd_new_{c}`").alias(c))
    return joined.select(*out)

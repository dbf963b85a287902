"""Row filters (F1-F8): intervals, value lists, their conjunction, and split filters.

Every filter is a plain Column predicate, so Catalyst pushes it into the
parquet scan (``PushedFilters``) and prunes row groups by statistics.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import qcol


def _literal(v) -> Column:
    """Naive datetimes are wall-clock values (independent of the session time zone)."""
    import datetime as dt

    if isinstance(v, dt.datetime) and v.tzinfo is None:
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v)


@dataclass(frozen=True)
class IntervalFilter:
    """Closed interval ``min <= col <= max`` (NULL drops the row)."""

    colname: str
    min: object
    max: object

    def predicate(self) -> Column:
        return qcol(self.colname).between(_literal(self.min), _literal(self.max))

    def to_dict(self) -> dict:
        return {"type": "interval", "colname": self.colname, "interval": {"min": self.min, "max": self.max}}


@dataclass(frozen=True)
class ListFilter:
    """``col IN list``; an empty list keeps no rows; NULL in the list is an error."""

    colname: str
    list: tuple

    def __post_init__(self):
        values = tuple(self.list)
        if any(v is None for v in values):
            raise ValueError(f"missing value in list filter on {self.colname!r}")
        object.__setattr__(self, "list", values)

    def predicate(self) -> Column:
        if not self.list:
            return F.lit(False)
        return qcol(self.colname).isin(list(self.list))

    def to_dict(self) -> dict:
        return {"type": "list", "colname": self.colname, "list": list(self.list)}


Filter = IntervalFilter | ListFilter


def filter_from_dict(d: Mapping) -> Filter:
    """Filter from its config dict ``{"type": "interval"|"list", ...}``."""
    kind = d.get("type")
    if kind == "interval":
        iv = d["interval"]
        return IntervalFilter(d["colname"], iv["min"], iv["max"])
    if kind == "list":
        return ListFilter(d["colname"], tuple(d["list"]))
    raise ValueError(f"unknown filter type {kind!r}; valid: interval, list")


def conjunction(filters: Sequence[Filter]) -> Column:
    """AND of all predicates; no filters keeps every row."""
    return functools.reduce(lambda a, b: a & b, (f.predicate() for f in filters), F.lit(True))


def select(df: DataFrame, filters: Sequence[Filter | Mapping] = (),
           transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Filter then optionally transform."""
    fs = [f if isinstance(f, (IntervalFilter, ListFilter)) else filter_from_dict(f) for f in filters]
    out = df.where(conjunction(fs)) if fs else df
    return transform(out) if transform else out


def training_rows(df: DataFrame, partition: str | None) -> DataFrame:
    """Rows with ``partition == 1``; no partition column keeps every row."""
    return df if partition is None else df.where(qcol(partition) == 1)


def split_rows(df: DataFrame, partition: str | None, i: int) -> DataFrame:
    """Rows of split ``i``; without a partition column all rows are split 1 (F8)."""
    if partition is None:
        return df if i == 1 else df.where(F.lit(False))
    return df.where(qcol(partition) == i)

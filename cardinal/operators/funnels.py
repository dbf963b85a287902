"""Where a network's rows come from: the extension point for sources of more than one table.

A funnel says which columns order, feed and label a network, and which named
helper tables it needs beside the node's table.  ``rows`` joins them as
DataFrames, so features of any size stay on the executors, and returns each
row of the node's table once with the columns that ``inputs`` and ``targets``
name.  Funnels are dataclasses registered by name; cards keep their config,
while the tables are bound when the card is used (:meth:`Funnel.bind`).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import qcol

FUNNELS: dict[str, type] = {}


def register_funnel(name: str):
    """Class decorator that makes a funnel known to configs under ``name``."""

    def deco(cls):
        cls.type = name
        FUNNELS[name] = cls
        return cls

    return deco


def funnel_from_dict(d: "Mapping | Funnel") -> "Funnel":
    if isinstance(d, Funnel):
        return d
    d = dict(d)
    kind = d.pop("type", None)
    if kind not in FUNNELS:
        raise ValueError(f"unknown funnel {kind!r}; valid: {', '.join(sorted(FUNNELS))}")
    extra = set(d) - {f.name for f in dataclasses.fields(FUNNELS[kind])}
    if extra:
        raise ValueError(f"unknown fields for funnel {kind!r}: {sorted(extra)}")
    return FUNNELS[kind](**d)


def _names(obj, *fields: str) -> None:
    for f in fields:
        v = getattr(obj, f)
        object.__setattr__(obj, f, (v,) if isinstance(v, str) else tuple(v))


class Funnel:
    """Base of funnels: dataclasses with ``inputs``, ``targets`` and ``order_by`` columns of :meth:`rows`."""

    type: ClassVar[str] = ""
    inputs: tuple
    targets: tuple
    order_by: tuple

    def helper_keys(self) -> tuple:
        """Names of the tables that must be bound; none by default."""
        return ()

    def reads(self) -> list[str]:
        """Columns of the node's own table that :meth:`rows` needs to predict."""
        return list(self.inputs)

    def check(self, helpers: Mapping[str, DataFrame]) -> None:
        """Raise if the bound tables cannot serve; nothing to check by default."""

    def rows(self, df: DataFrame, helpers: Mapping[str, DataFrame]) -> DataFrame:
        """``df`` with the columns of ``inputs`` and ``targets`` added, every row once."""
        return df

    def bind(self, helpers: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The helper tables, after a check that they are the expected ones."""
        if set(helpers) != set(self.helper_keys()):
            raise ValueError(f"funnel {self.type!r} takes the helper tables {sorted(self.helper_keys())}, not {sorted(helpers)}")
        self.check(helpers)
        return dict(helpers)

    def to_dict(self) -> dict:
        return {"type": self.type} | {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else v
                                      for f in dataclasses.fields(self)}


@register_funnel("table")
@dataclass(frozen=True)
class TableFunnel(Funnel):
    """The node's table alone."""

    inputs: tuple
    targets: tuple
    order_by: tuple

    def __post_init__(self):
        _names(self, "inputs", "targets", "order_by")


@register_funnel("lookup")
@dataclass(frozen=True)
class LookupFunnel(Funnel):
    """Columns of a second table, found by key, as inputs beside or instead of the node's own.

    ``on`` pairs columns of the node's table with those of the helper table
    ``lookup``, whose keys must be unique (bound tables are checked; NULL keys
    match nothing).  ``columns`` are the helper's inputs; they come in under
    ``prefix`` + name.  A row without a partner has NULL inputs: it trains
    nothing and its prediction is NULL.  The join is left to Catalyst, which
    broadcasts by measured size or shuffles with skew splitting.
    """

    on: tuple
    columns: tuple
    targets: tuple
    order_by: tuple
    own: tuple = ()
    prefix: str = "lookup_"

    def __post_init__(self):
        _names(self, "columns", "targets", "order_by", "own")
        object.__setattr__(self, "on", tuple(tuple(p) for p in self.on))
        if not self.on or not self.columns:
            raise ValueError("a lookup needs key pairs and columns")

    @property
    def inputs(self) -> tuple:
        return self.own + tuple(self.prefix + c for c in self.columns)

    def helper_keys(self) -> tuple:
        return ("lookup",)

    def reads(self) -> list[str]:
        return list(dict.fromkeys([a for a, _ in self.on] + list(self.own)))

    def check(self, helpers):
        keys = [qcol(b) for _, b in self.on]
        known = helpers["lookup"].where(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]))
        twice = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cd_n")).where("_cd_n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"the lookup table has more than one row for the key {list(twice[0])[:-1]}")

    def rows(self, df, helpers):
        clash = [self.prefix + c for c in self.columns if self.prefix + c in df.columns]
        if clash:
            raise ValueError(f"columns {clash} are in the table already; choose another prefix")
        side = helpers["lookup"].select(*[qcol(b).alias(f"_cd_key{i}") for i, (_, b) in enumerate(self.on)],
                                        *[qcol(c).alias(self.prefix + c) for c in self.columns])
        match = [qcol(a) == F.col(f"_cd_key{i}") for i, (a, _) in enumerate(self.on)]
        joined = df.join(side, match[0] if len(match) == 1 else [*match], "left")
        return joined.drop(*[f"_cd_key{i}" for i in range(len(self.on))])

"""Rescale card (R1-R6): grouped statistics fitted on training rows.

Fit is one ``groupBy(group_by).agg(...)`` (map-side partial aggregation, so
a hot group costs nothing extra) over the training rows.  Without groups the
single statistics row (a few doubles) becomes literals; with groups the
statistics table is checkpointed and joined back by ``=`` on the keys,
broadcast only under a measured row bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import ieee_div, ieee_ln, join_names, qcol, unique
from cardinal.operators.filters import training_rows
from cardinal.operators.joins import join_stats
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, method_of, register_card
from cardinal.session import reliable_checkpoint


def _exp(x: Column) -> Column:
    return F.exp(x.cast("double"))


@dataclass(frozen=True)
class Rescaler:
    stats: tuple  # (name, aggregate builder)
    forward: Callable  # (x, stats dict) -> Column
    inverse: Callable  # (y, stats dict) -> Column


RESCALERS = {
    "zscore": Rescaler(
        (("mean", lambda c: F.avg(c)), ("std", lambda c: F.stddev_pop(c))),
        lambda x, s: ieee_div(x - s["mean"], s["std"]),
        lambda y, s: s["mean"] + s["std"] * y,
    ),
    "maxabs": Rescaler(
        (("maxabs", lambda c: F.max(F.abs(c))),),
        lambda x, s: ieee_div(x, s["maxabs"]),
        lambda y, s: s["maxabs"] * y,
    ),
    "minmax": Rescaler(
        (("max", lambda c: F.max(c)), ("min", lambda c: F.min(c))),
        lambda x, s: ieee_div(x - s["min"], s["max"] - s["min"]),
        lambda y, s: s["min"] + (s["max"] - s["min"]) * y,
    ),
    "log": Rescaler((), lambda x, s: ieee_ln(x), lambda y, s: _exp(y)),
    "logistic": Rescaler(
        (),
        lambda x, s: ieee_div(F.lit(1.0), F.lit(1.0) + _exp(-x.cast("double"))),
        lambda y, s: ieee_ln(ieee_div(y, F.lit(1.0) - y)),
    ),
}


def fit_stats(df: DataFrame, method: str, columns: list[str], group_by: list[str], partition: str | None):
    """Grouped statistics ``col_stat`` on training rows (A3, A4).

    Returns a dict of scalars (no groups) or a checkpointed DataFrame.
    """
    r = RESCALERS[method]
    aggs = [agg(qcol(c).cast("double")).cast("double").alias(join_names(c, name))
            for c in columns for name, agg in r.stats]
    train = training_rows(df, partition)
    if not group_by:
        return train.agg(*aggs).first().asDict()
    stats = train.groupBy(*[qcol(g) for g in group_by]).agg(*aggs)
    return reliable_checkpoint(stats)


def apply_rescale(df: DataFrame, method: str, columns: list[str], outputs: list[str], group_by: list[str],
                  stats, *, inverse_of: list[str] | None = None) -> DataFrame:
    """Add ``outputs`` = forward(columns) (or inverse(inverse_of) using stats of ``columns``)."""
    r = RESCALERS[method]
    cols = list(df.columns)
    if r.stats:
        joined, st = join_stats(df, stats, group_by)
    else:
        joined, st = df, {}
    exprs = []
    sources = inverse_of if inverse_of is not None else columns
    for c, src, out in zip(columns, sources, outputs):
        s = {name: st[join_names(c, name)] for name, _ in r.stats}
        x = qcol(src).cast("double")
        exprs.append((r.inverse(x, s) if inverse_of is not None else r.forward(x, s)).alias(out))
    keep = [qcol(c) for c in cols if c not in outputs]
    return joined.select(*keep, *exprs)


@register_card("rescale", "Rescale")
@dataclass(frozen=True)
class RescaleCard(Card):
    method: str
    inputs: tuple = ()
    targets: tuple = ()
    group_by: tuple = ()
    partition: str | None = None
    suffix: str = "rescaled"
    target_suffix: str | None = None
    invertible = True

    def __post_init__(self):
        for f in ("inputs", "targets", "group_by"):
            object.__setattr__(self, f, tuple(getattr(self, f)))
        if self.method not in RESCALERS:
            raise ValueError(f"unknown method {self.method!r}; valid: {', '.join(RESCALERS)}")
        if not self.suffix or self.target_suffix == "":
            raise ValueError("suffix and target_suffix must be non-empty")

    @classmethod
    def from_config(cls, d):
        check_fields(cls, d)
        d = dict(d)
        name, _ = method_of(d.pop("method"), list(RESCALERS))
        return cls(method=name, **d)

    def to_dict(self):
        out = super().to_dict()
        out["method"] = {"type": self.method}
        return out

    @property
    def columns(self) -> list[str]:
        return unique(list(self.inputs) + list(self.targets))

    def outputs(self) -> list[str]:
        return [join_names(c, self.suffix) for c in self.columns]

    def inverse_inputs(self) -> list[str]:
        base = [join_names(t, self.suffix) for t in self.targets]
        return [join_names(b, self.target_suffix) if self.target_suffix else b for b in base]

    def inverse_outputs(self) -> list[str]:
        return [join_names(t, self.target_suffix) if self.target_suffix else t for t in self.targets]

    def source_variables(self):
        return SourceVariables(group_by=list(self.group_by), inputs=list(self.inputs),
                               inverse_inputs=self.inverse_inputs(), targets=list(self.targets),
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables(self.outputs(), self.inverse_outputs())

    def fit(self, df, id_var=None):
        if not RESCALERS[self.method].stats:
            return CardState()
        stats = fit_stats(df, self.method, self.columns, list(self.group_by), self.partition)
        if isinstance(stats, dict):
            return CardState(content={"stats": stats})
        return CardState(tables={"stats": stats})

    def _stats(self, state: CardState):
        return state.tables.get("stats", state.content.get("stats"))

    def transform(self, df, state, id_var=None):
        return apply_rescale(df, self.method, self.columns, self.outputs(), list(self.group_by), self._stats(state))

    def inverse_transform(self, df, state, id_var=None):
        return apply_rescale(df, self.method, list(self.targets), self.inverse_outputs(), list(self.group_by),
                             self._stats(state), inverse_of=self.inverse_inputs())

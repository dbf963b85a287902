"""User-defined ("wild") cards.

A wild card is registered with two DataFrame functions: ``fit(df) -> model``
(runs Spark jobs, returns a small model) and ``transform(df, model, id) ->
DataFrame`` returning exactly the id column and the declared outputs.  The
result is update-joined back into the table by id (J3), so user code never
handles more than a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cardinal.functions.columns import join_names
from cardinal.operators.filters import training_rows
from cardinal.operators.joins import update_join
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, register_card


@dataclass(frozen=True)
class WildSpec:
    fit: Callable[[DataFrame], object]
    transform: Callable[[DataFrame, object, str], DataFrame]
    label: str
    needs_order: bool = False
    needs_targets: bool = False
    allows_weights: bool = False
    allows_partition: bool = False


WILD_CARDS: dict[str, WildSpec] = {}


def register_wild_card(key: str, label: str, fit: Callable, transform: Callable, *, needs_order: bool = False,
                       needs_targets: bool = False, allows_weights: bool = False, allows_partition: bool = False) -> None:
    """Register a user card type under ``key``."""
    WILD_CARDS[key] = WildSpec(fit, transform, label, needs_order, needs_targets, allows_weights, allows_partition)


@register_card("wild", "User-defined")
@dataclass(frozen=True)
class WildCard(Card):
    name: str
    inputs: tuple = ()
    targets: tuple = ()
    order_by: tuple = ()
    weights: str | None = None
    partition: str | None = None
    suffix: str | None = None
    outputs: tuple = ()
    keyed = True

    def __post_init__(self):
        for f in ("inputs", "targets", "order_by", "outputs"):
            object.__setattr__(self, f, tuple(getattr(self, f)))
        if self.name not in WILD_CARDS:
            raise ValueError(f"unknown wild card {self.name!r}; registered: {', '.join(sorted(WILD_CARDS))}")
        spec = WILD_CARDS[self.name]
        if spec.needs_order and not self.order_by:
            raise ValueError(f"{self.name} needs order_by")
        if spec.needs_targets and not self.targets:
            raise ValueError(f"{self.name} needs targets")
        if self.weights and not spec.allows_weights:
            raise ValueError(f"{self.name} does not take weights")
        if self.partition and not spec.allows_partition:
            raise ValueError(f"{self.name} does not take a partition")
        if not self.outputs and not (self.targets and self.suffix):
            raise ValueError("outputs are required unless targets and suffix are given")

    def output_names(self) -> list[str]:
        return list(self.outputs) or [join_names(t, self.suffix) for t in self.targets]

    def source_variables(self):
        return SourceVariables(order_by=list(self.order_by), inputs=list(self.inputs), targets=list(self.targets),
                               weights=[self.weights] if self.weights else [],
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables(self.output_names())

    def fit(self, df, id_var=None):
        cols = [c for c in ([id_var] if id_var else []) + self.source_variables().all() if c in df.columns]
        model = WILD_CARDS[self.name].fit(training_rows(df, self.partition).select(*dict.fromkeys(cols)))
        return CardState(content={"model": model})

    def transform(self, df, state, id_var=None):
        if not id_var:
            raise ValueError("wild cards need an id column")
        res = WILD_CARDS[self.name].transform(df, state.content["model"], id_var)
        expected = {id_var, *self.output_names()}
        if set(res.columns) != expected:
            raise ValueError(f"wild card {self.name} returned {sorted(res.columns)}, expected {sorted(expected)}")
        return update_join(df, res, id_var, self.output_names())

"""Card base class, variables, registry and config round trip.

A card is a frozen configuration of a column-adding transform.  ``fit``
runs Spark jobs on the training rows and returns a small ``CardState``;
``transform`` returns a lazy DataFrame with the output columns added.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from cardinal.functions.columns import unique


@dataclass
class SourceVariables:
    order_by: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    helpers: list[str] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)
    inverse_inputs: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    weights: list[str] = field(default_factory=list)
    partition: list[str] = field(default_factory=list)

    def all(self) -> list[str]:
        return unique(self.order_by + self.group_by + self.helpers + self.inputs + self.targets
                      + self.weights + self.partition)


@dataclass
class OutputVariables:
    outputs: list[str] = field(default_factory=list)
    inverse_outputs: list[str] = field(default_factory=list)


@dataclass
class CardState:
    """Fitted parameters: a JSON-able dict plus optional keyed tables.

    ``tables`` hold DataFrames whose size grows with the number of groups
    (e.g. grouped statistics); they are materialised, never collected.
    """

    content: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)


def _as_list(v) -> list:
    if v is None:
        return []
    if isinstance(v, str):
        return [v]
    return list(v)


def single(v, name: str):
    """A one-element list is accepted for a single-column field; longer is an error."""
    if isinstance(v, (list, tuple)):
        if len(v) != 1:
            raise ValueError(f"{name} takes exactly one column, got {len(v)}")
        return v[0]
    return v


CARD_REGISTRY: dict[str, tuple[type, str]] = {}


def register_card(key: str, label: str | None = None):
    """Class decorator registering a card type under ``key``."""

    def deco(cls):
        cls.type = key
        CARD_REGISTRY[key] = (cls, label or key)
        return cls

    return deco


class Card:
    """Base class; subclasses are dataclasses registered with :func:`register_card`."""

    type: ClassVar[str] = ""
    invertible: ClassVar[bool] = False
    # Cards whose outputs are per-row expressions fuse into the table with
    # withColumn; keyed cards return (id, outputs) and are joined back.
    keyed: ClassVar[bool] = False
    streamable: ClassVar[bool] = True

    def source_variables(self) -> SourceVariables:
        raise NotImplementedError

    def output_variables(self) -> OutputVariables:
        raise NotImplementedError

    def fit(self, df: DataFrame, id_var: str | None = None) -> CardState:
        return CardState()

    def transform(self, df: DataFrame, state: CardState, id_var: str | None = None) -> DataFrame:
        raise NotImplementedError

    def inverse_transform(self, df: DataFrame, state: CardState, id_var: str | None = None) -> DataFrame:
        raise ValueError(f"card {self.type!r} is not invertible")

    def report(self, state: CardState) -> dict:
        return {}

    # -- config round trip ---------------------------------------------------
    def to_dict(self) -> dict:
        out = {"type": self.type}
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if hasattr(v, "to_dict"):
                v = v.to_dict()
            elif isinstance(v, tuple):
                v = list(v)
            out[f.name] = v
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


def load_builtin_cards() -> None:
    """Import the operator modules so their cards register themselves."""
    import importlib

    for mod in ("split", "rescale", "gaussian", "cluster", "dimred", "glm", "mixed", "interp", "nn", "wild"):
        importlib.import_module(f"cardinal.operators.{mod}")


def card_from_dict(d: Mapping[str, Any]) -> Card:
    """Build a card from its config dict (L1).

    ``type`` picks the card; unknown keys are rejected; required fields must
    be present.  Method dicts are handled by each card's ``from_config``.
    """
    load_builtin_cards()
    d = dict(d)
    kind = d.pop("type", None)
    if kind not in CARD_REGISTRY:
        raise ValueError(f"unknown card type {kind!r}; valid: {', '.join(sorted(CARD_REGISTRY))}")
    cls = CARD_REGISTRY[kind][0]
    d.pop("label", None)
    if hasattr(cls, "from_config"):
        return cls.from_config(d)
    names = {f.name for f in dataclasses.fields(cls)}
    extra = set(d) - names
    if extra:
        raise ValueError(f"unknown fields for card {kind!r}: {sorted(extra)}")
    return cls(**d)


def check_fields(cls, d: Mapping[str, Any], also: Sequence[str] = ()) -> None:
    names = {f.name for f in dataclasses.fields(cls)} | set(also)
    extra = set(d) - names
    if extra:
        raise ValueError(f"unknown fields for card {cls.type!r}: {sorted(extra)}")


def method_of(d: Mapping[str, Any] | str, valid: Sequence[str]) -> tuple[str, dict]:
    """Split a ``method`` config (``"zscore"`` or ``{"type": ..., params}``)."""
    if isinstance(d, str):
        name, params = d, {}
    else:
        params = dict(d)
        name = params.pop("type", None)
    if name not in valid:
        raise ValueError(f"unknown method {name!r}; valid: {', '.join(valid)}")
    return name, params

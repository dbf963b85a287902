"""Split and window-function cards (W1-W6) on top of the skew-safe ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cardinal.operators import ranking
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, method_of, register_card


@dataclass(frozen=True)
class PercentileMethod:
    percentile: float

    def __post_init__(self):
        if not 0 <= self.percentile <= 1:
            raise ValueError("percentile must be in [0, 1]")

    def to_dict(self):
        return {"type": "percentile", "percentile": self.percentile}


@dataclass(frozen=True)
class TilesMethod:
    tiles: tuple
    repeat: int = 1
    tail: int = 0

    def __post_init__(self):
        object.__setattr__(self, "tiles", tuple(self.tiles))
        if not self.tiles or any(t not in (1, 2) for t in self.tiles):
            raise ValueError("tiles must be a non-empty list of 1 and 2")
        if self.repeat < 1 or self.tail < 0:
            raise ValueError("repeat must be >= 1 and tail >= 0")

    def to_dict(self):
        return {"type": "tiles", "tiles": list(self.tiles), "repeat": self.repeat, "tail": self.tail}


SPLITTING_METHODS = {"percentile": PercentileMethod, "tiles": TilesMethod}


@register_card("split", "Split")
@dataclass(frozen=True)
class SplitCard(Card):
    """Training (1) / validation (2) column from an ordered split."""

    method: PercentileMethod | TilesMethod
    order_by: tuple = ()
    group_by: tuple = ()
    output: str = "partition"
    tiebreak: tuple = ()
    streamable = False

    def __post_init__(self):
        object.__setattr__(self, "order_by", tuple(self.order_by))
        object.__setattr__(self, "group_by", tuple(self.group_by))
        object.__setattr__(self, "tiebreak", tuple(self.tiebreak))
        if not self.order_by:
            raise ValueError("split.order_by must not be empty")
        if not self.output:
            raise ValueError("split.output must not be empty")

    @classmethod
    def from_config(cls, d):
        check_fields(cls, d)
        d = dict(d)
        name, params = method_of(d.pop("method"), list(SPLITTING_METHODS))
        return cls(method=SPLITTING_METHODS[name](**params), **d)

    def source_variables(self):
        return SourceVariables(order_by=list(self.order_by), group_by=list(self.group_by))

    def output_variables(self):
        return OutputVariables([self.output])

    def transform(self, df: DataFrame, state: CardState, id_var: str | None = None) -> DataFrame:
        tb = list(self.tiebreak) or ([id_var] if id_var else None)
        if isinstance(self.method, PercentileMethod):
            return ranking.percentile_split(df, self.method.percentile, self.order_by, self.group_by,
                                            self.output, tiebreak=tb)
        m = self.method
        return ranking.tiles_split(df, m.tiles, self.order_by, self.group_by, m.repeat, m.tail,
                                   self.output, tiebreak=tb)


@register_card("window_function", "Window function")
@dataclass(frozen=True)
class WindowFunctionCard(Card):
    """``method() OVER (PARTITION BY group_by ORDER BY order_by)`` as a new column."""

    method: str
    order_by: tuple
    output: str
    group_by: tuple = ()
    tiebreak: tuple = ()
    streamable = False

    def __post_init__(self):
        object.__setattr__(self, "order_by", tuple(self.order_by))
        object.__setattr__(self, "group_by", tuple(self.group_by))
        object.__setattr__(self, "tiebreak", tuple(self.tiebreak))
        if self.method not in ranking.WINDOW_METHODS:
            raise ValueError(f"unknown method {self.method!r}; valid: {', '.join(ranking.WINDOW_METHODS)}")
        if not self.order_by or not self.output:
            raise ValueError("window_function needs order_by and output")

    @classmethod
    def from_config(cls, d):
        check_fields(cls, d)
        d = dict(d)
        name, _ = method_of(d.pop("method"), list(ranking.WINDOW_METHODS))
        return cls(method=name, **d)

    def to_dict(self):
        out = super().to_dict()
        out["method"] = {"type": self.method}
        return out

    def source_variables(self):
        return SourceVariables(order_by=list(self.order_by), group_by=list(self.group_by))

    def output_variables(self):
        return OutputVariables([self.output])

    def transform(self, df, state, id_var=None):
        tb = list(self.tiebreak) or ([id_var] if id_var else None)
        return ranking.window_function(df, self.method, self.order_by, self.group_by, self.output, tiebreak=tb)

"""Gaussian (cyclic) encoding card (E1-E6): a pure per-row projection.

For ``i = 1..n``: ``mu_i = (i-1)/n``, ``sigma = lambda/n``,
``eta = f(x)/max - mu_i`` and the output is
``exp(-(|eta - round(eta)| / sigma)^2 / 2) / sqrt(2 pi)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardinal.functions.columns import join_names, qcol
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, method_of, register_card

# Preprocessing method -> default period ("max").
DEFAULT_MAX = {
    "identity": 1.0,
    "dayofweek": 7.0,
    "dayofyear": 366.0,
    "hourofday": 24.0,
    "minuteofday": 1440.0,
    "minuteofhour": 60.0,
}


def preprocess(method: str, x: Column) -> Column:
    """Temporal feature of ``x``; day of week counts Sunday as 0."""
    if method == "identity":
        return x
    if method == "dayofweek":
        return F.dayofweek(x) - 1
    if method == "dayofyear":
        return F.dayofyear(x)
    if method == "hourofday":
        return F.hour(x)
    if method == "minuteofday":
        return F.hour(x) * 60 + F.minute(x)
    if method == "minuteofhour":
        return F.minute(x)
    raise ValueError(f"unknown method {method!r}; valid: {', '.join(DEFAULT_MAX)}")


def gaussian_columns(x: Column, n: int, lam: float, period: float, names: list[str]) -> list[Column]:
    sigma = lam / n
    c = math.sqrt(2 * math.pi)
    scaled = x.cast("double") / F.lit(float(period))
    out = []
    for i, name in enumerate(names):
        eta = scaled - F.lit(i / n)
        omega = F.abs(eta - F.round(eta)) / F.lit(float(sigma))
        out.append((F.exp(-omega * omega / F.lit(2.0)) / F.lit(c)).alias(name))
    return out


@register_card("gaussian_encoding", "Gaussian encoding")
@dataclass(frozen=True)
class GaussianEncodingCard(Card):
    input: str
    n_components: int
    method: str = "identity"
    max: float | None = None
    lambda_: float = 0.5
    suffix: str = "gaussian"

    def __post_init__(self):
        if self.method not in DEFAULT_MAX:
            raise ValueError(f"unknown method {self.method!r}; valid: {', '.join(DEFAULT_MAX)}")
        if self.n_components < 1 or self.lambda_ <= 0:
            raise ValueError("n_components must be >= 1 and lambda > 0")
        object.__setattr__(self, "max", float(self.max if self.max is not None else DEFAULT_MAX[self.method]))

    @classmethod
    def from_config(cls, d):
        d = dict(d)
        if "lambda" in d:
            d["lambda_"] = d.pop("lambda")
        check_fields(cls, d)
        name, params = method_of(d.pop("method", "identity"), list(DEFAULT_MAX))
        return cls(method=name, max=params.get("max"), **d)

    def to_dict(self):
        return {"type": self.type, "method": {"type": self.method, "max": self.period},
                "input": self.input, "n_components": self.n_components, "lambda": self.lambda_,
                "suffix": self.suffix}

    @property
    def period(self) -> float:
        return float(self.max if self.max is not None else DEFAULT_MAX[self.method])

    def outputs(self) -> list[str]:
        return [join_names(self.input, self.suffix, i) for i in range(1, self.n_components + 1)]

    def source_variables(self):
        return SourceVariables(inputs=[self.input])

    def output_variables(self):
        return OutputVariables(self.outputs())

    def transform(self, df, state: CardState, id_var=None):
        x = preprocess(self.method, qcol(self.input))
        outs = self.outputs()
        keep = [qcol(c) for c in df.columns if c not in outs]
        return df.select(*keep, *gaussian_columns(x, self.n_components, self.lambda_, self.period, outs))

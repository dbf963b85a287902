"""Dissimilarities D1-D9 as Spark column expressions.

A point is either a list of numeric columns or one array column.  Centres
are small literal vectors (k x d numbers), so every distance stays a
codegen'd expression: no UDF, no join with the centres.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Distance names, the weighted ones, and the true metrics.
DISTANCES = (
    "sqeuclidean", "weighted_sqeuclidean", "euclidean", "cityblock", "chebyshev",
    "minkowski", "weighted_euclidean", "weighted_cityblock", "weighted_minkowski",
)
METRICS = ("euclidean", "cityblock", "chebyshev", "minkowski", "weighted_euclidean",
           "weighted_cityblock", "weighted_minkowski")


@dataclass(frozen=True)
class Dissimilarity:
    type: str = "sqeuclidean"
    p: float = 2.0
    weights: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if self.type not in DISTANCES:
            raise ValueError(f"unknown dissimilarity {self.type!r}; valid: {', '.join(DISTANCES)}")
        if "minkowski" in self.type and self.p < 1:
            raise ValueError("minkowski needs p >= 1")
        if self.type.startswith("weighted"):
            if not self.weights or any(w <= 0 for w in self.weights):
                raise ValueError("weighted dissimilarities need positive weights")
        object.__setattr__(self, "weights", tuple(float(w) for w in self.weights))

    @classmethod
    def from_config(cls, d) -> "Dissimilarity":
        if d is None:
            return cls()
        if isinstance(d, str):
            return cls(d)
        d = dict(d)
        return cls(d.pop("type", "sqeuclidean"), float(d.pop("p", 2.0)), tuple(d.pop("weights", ())))

    def to_dict(self) -> dict:
        out = {"type": self.type}
        if "minkowski" in self.type:
            out["p"] = self.p
        if self.weights:
            out["weights"] = list(self.weights)
        return out

    @property
    def is_metric(self) -> bool:
        return self.type in METRICS

    def _w(self, d: int) -> np.ndarray:
        if not self.type.startswith("weighted"):
            return np.ones(d)
        if len(self.weights) != d:
            raise ValueError(f"{len(self.weights)} weights for {d} inputs")
        return np.asarray(self.weights)

    # -- column expressions ------------------------------------------------------
    def column(self, xs: Sequence[Column], centre: Sequence[float]) -> Column:
        """Distance from the point given by columns ``xs`` to a literal ``centre``."""
        w = self._w(len(xs))
        diffs = [x.cast("double") - F.lit(float(c)) for x, c in zip(xs, centre)]
        return self._combine(diffs, w)

    def _combine(self, diffs: list[Column], w: np.ndarray) -> Column:
        t = self.type
        if t in ("sqeuclidean", "euclidean", "weighted_sqeuclidean", "weighted_euclidean"):
            s = _sum([F.lit(float(wi)) * d * d for d, wi in zip(diffs, w)])
            return F.sqrt(s) if t.endswith("euclidean") and "sq" not in t else s
        if t in ("cityblock", "weighted_cityblock"):
            return _sum([F.lit(float(wi)) * F.abs(d) for d, wi in zip(diffs, w)])
        if t == "chebyshev":
            return F.greatest(*[F.abs(d) for d in diffs]) if len(diffs) > 1 else F.abs(diffs[0])
        p = float(self.p)
        s = _sum([F.lit(float(wi)) * F.pow(F.abs(d), F.lit(p)) for d, wi in zip(diffs, w)])
        return F.pow(s, F.lit(1.0 / p))

    def array_column(self, arr: Column, centre: Sequence[float]) -> Column:
        """Distance from an array column to a literal centre (higher-order functions, JVM-side)."""
        c = F.array(*[F.lit(float(v)) for v in centre])
        w = F.array(*[F.lit(float(v)) for v in self._w(len(centre))])
        d = F.zip_with(arr, c, lambda a, b: a.cast("double") - b)
        t = self.type
        if t in ("sqeuclidean", "euclidean", "weighted_sqeuclidean", "weighted_euclidean"):
            terms = F.zip_with(d, w, lambda a, b: b * a * a)
            s = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
            return F.sqrt(s) if "sq" not in t else s
        if t in ("cityblock", "weighted_cityblock"):
            terms = F.zip_with(d, w, lambda a, b: b * F.abs(a))
            return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
        if t == "chebyshev":
            return F.array_max(F.transform(d, lambda a: F.abs(a)))
        p = float(self.p)
        terms = F.zip_with(d, w, lambda a, b: b * F.pow(F.abs(a), F.lit(p)))
        return F.pow(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v), F.lit(1.0 / p))

    # -- numpy (driver-side checks, small centre sets) ---------------------------
    def numpy(self, X: np.ndarray, c: np.ndarray) -> np.ndarray:
        w = self._w(X.shape[1])
        d = X - c
        t = self.type
        if t in ("sqeuclidean", "weighted_sqeuclidean"):
            return (w * d * d).sum(1)
        if t in ("euclidean", "weighted_euclidean"):
            return np.sqrt((w * d * d).sum(1))
        if t in ("cityblock", "weighted_cityblock"):
            return (w * np.abs(d)).sum(1)
        if t == "chebyshev":
            return np.abs(d).max(1)
        return ((w * np.abs(d) ** self.p).sum(1)) ** (1 / self.p)


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def argmin_label(dists: Sequence[Column]) -> Column:
    """1-based index of the smallest distance (first one on ties)."""
    arr = F.array(*[d.cast("double") for d in dists])
    return F.array_position(arr, F.array_min(arr)).cast("int")

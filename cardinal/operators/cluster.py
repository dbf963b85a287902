"""Clustering cards (K1, K4) with any dissimilarity D1-D9.

k-means is a distributed Lloyd loop: each iteration assigns points to the
k centres in Arrow-batched numpy and emits per-partition partial sums of
``w*x``, ``w`` and the objective (k x d numbers per partition).  Prediction
assigns labels with JVM-side column expressions (centres are literals).  The
loop reads the same cached training rows every time, so its lineage does not
grow.  Initial centres come from k-means|| over all rows: rounds of draws in
proportion to a row's cost, the few drawn rows weighted by the rows nearest to
them and reduced to k by k-means++.

DBSCAN (K2) lives in ``density``; its fitted state is the table of distinct
training points with their labels, and prediction is a join on the point.

Not built (see README): affinity propagation, which needs the N x N similarity
matrix by definition.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import qcol
from cardinal.functions.distances import Dissimilarity, argmin_label
from cardinal.functions.partials import sum_partials
from cardinal.operators.density import dbscan_points
from cardinal.operators.filters import training_rows
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, method_of, register_card
from cardinal.session import reliable_checkpoint

SEED_ROUNDS = 2
OVERSAMPLE = 2


def feature_columns(df: DataFrame, inputs: list[str]) -> list[Column]:
    """Numeric feature columns; a single array column expands to its elements (all arrays equally long)."""
    if len(inputs) == 1 and df.schema[inputs[0]].dataType.typeName() == "array":
        sizes = df.where(qcol(inputs[0]).isNotNull()).agg(F.min(F.size(qcol(inputs[0]))), F.max(F.size(qcol(inputs[0])))).first()
        if sizes[0] != sizes[1]:
            raise ValueError(f"{inputs[0]!r} holds arrays of {sizes[0]} to {sizes[1]} elements")
        return [qcol(inputs[0])[i].cast("double") for i in range(sizes[0] or 0)]
    return [qcol(c).cast("double") for c in inputs]


def assign(xs: list[Column], centres: np.ndarray, dist: Dissimilarity) -> Column:
    """1-based nearest-centre label, as one expression."""
    arr = F.array(*[x.cast("double") for x in xs])
    return argmin_label([dist.array_column(arr, c) for c in centres])


def _kmeanspp(X: np.ndarray, w: np.ndarray, k: int, dist: Dissimilarity, rng: np.random.Generator) -> np.ndarray:
    centres = [X[rng.choice(len(X), p=w / w.sum())]]
    d = dist.numpy(X, centres[0])
    for _ in range(1, k):
        p = w * np.maximum(d, 0) ** (1 if dist.type.startswith(("sq", "weighted_sq")) else 2)
        if p.sum() <= 0:
            c = X[rng.integers(len(X))]
        else:
            c = X[rng.choice(len(X), p=p / p.sum())]
        centres.append(c)
        d = np.minimum(d, dist.numpy(X, c))
    return np.asarray(centres)


def nearest(X: np.ndarray, centres: np.ndarray, dist: Dissimilarity) -> tuple[np.ndarray, np.ndarray]:
    """(index, cost) of the nearest centre; the first minimum on ties, as the column expression."""
    D = np.column_stack([dist.numpy(X, c) for c in centres])
    lab = D.argmin(1)
    return lab, D[np.arange(len(lab)), lab]


def _points(pdf) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_numpy()).astype(float), pdf["w"].to_numpy(dtype=float)


def lloyd_step(feats: DataFrame, centres: np.ndarray, dist: Dissimilarity, partitions: int):
    """One Lloyd step over ``(x array, w)`` rows; returns (sums k x d, weights k, objective k)."""
    import pandas as pd

    k, d = centres.shape

    def kernel(it):
        sums, sw, obj = np.zeros((k, d)), np.zeros(k), np.zeros(k)
        for pdf in it:
            if pdf.empty:
                continue
            X, w = _points(pdf)
            lab, cost = nearest(X, centres, dist)
            own = np.zeros((len(lab), k))
            own[np.arange(len(lab)), lab] = w
            sums += own.T @ X
            sw += own.sum(0)
            obj += np.bincount(lab, weights=w * cost, minlength=k)
        yield pd.DataFrame({"s": [sums.ravel().tolist()], "sw": [sw.tolist()], "obj": [obj.tolist()]})

    part = feats.select("x", "w").mapInPandas(kernel, "s array<double>, sw array<double>, obj array<double>")
    arr, _ = sum_partials(part, partitions, {"s": k * d, "sw": k, "obj": k}, [])
    return arr["s"].reshape(k, d), arr["sw"], arr["obj"]


def seed_centres(feats: DataFrame, k: int, dist: Dissimilarity, partitions: int, seed: int) -> np.ndarray:
    """k-means||: about OVERSAMPLE * k rows drawn per round, whatever the number of rows, from all rows."""
    import pandas as pd

    power = 1 if dist.type.startswith(("sq", "weighted_sq")) else 2
    first = feats.where("w > 0").orderBy(F.xxhash64(F.lit(seed), "x")).select("x").first()
    if first is None:
        raise ValueError("no row has a positive weight")
    drawn = np.asarray([first["x"]], dtype=float)
    for step in range(SEED_ROUNDS):
        centres = drawn

        def cost(it, centres=centres):
            for pdf in it:
                if not pdf.empty:
                    X, w = _points(pdf)
                    yield pd.DataFrame({"x": pdf["x"], "c": w * np.maximum(nearest(X, centres, dist)[1], 0) ** power})

        costs = feats.select("x", "w").mapInPandas(cost, "x array<double>, c double")
        total = costs.agg(F.sum("c")).first()[0]
        if not total:
            break
        draw = F.rand(seed + step)  # for each row: equal rows are drawn independently
        more = costs.where(draw < F.col("c") * (OVERSAMPLE * k / total)).select("x").distinct().collect()
        if more:
            drawn = np.unique(np.vstack([drawn, np.asarray([r["x"] for r in more], dtype=float)]), axis=0)
    weights = lloyd_step(feats, drawn, dist, partitions)[1]
    return _kmeanspp(drawn, np.maximum(weights, 1e-12), k, dist, np.random.default_rng(seed))


def kmeans_fit(df: DataFrame, inputs: list[str], k: int, *, weights: str | None = None,
               dist: Dissimilarity = Dissimilarity(), iterations: int = 100, tol: float = 1e-6,
               seed: int = 0) -> dict:
    """Fit centres on all rows of ``df``; returns ``{"centres", "iterations", "objective"}``.

    Points are held as one double array per row and persisted once; each
    iteration is one Lloyd step (:func:`lloyd_step`).
    """
    xs = feature_columns(df, inputs)
    w = qcol(weights).cast("double") if weights else F.lit(1.0)
    feats = df.select(F.array(*xs).alias("x"), w.alias("w")).where(
        ~F.exists("x", lambda v: v.isNull()) & F.col("w").isNotNull())
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = feats.count()
        if n < k:
            raise ValueError(f"{n} rows for {k} clusters")
        partitions = feats.rdd.getNumPartitions()
        centres = seed_centres(feats, k, dist, partitions, seed)
        prev_obj = np.inf
        it, done = 0, False
        for it in range(1, iterations + 1):
            sums, sw, objs = lloyd_step(feats, centres, dist, partitions)
            obj = float(objs.sum())
            centres = np.where(sw[:, None] > 0, sums / np.where(sw > 0, sw, 1.0)[:, None], centres)
            done = abs(prev_obj - obj) <= tol * max(1.0, abs(obj))
            prev_obj = obj
            if done:
                break
        return {"centres": centres, "iterations": it, "objective": float(prev_obj), "converged": bool(done)}
    finally:
        feats.unpersist()


@dataclass(frozen=True)
class KMeansMethod:
    classes: int
    iterations: int = 100
    tol: float = 1e-6
    seed: int = 0
    dissimilarity: Dissimilarity = field(default_factory=Dissimilarity)

    def __post_init__(self):
        if self.classes < 1 or self.iterations < 1 or self.tol <= 0 or self.seed < 0:
            raise ValueError("kmeans: classes >= 1, iterations >= 1, tol > 0, seed >= 0")

    def to_dict(self):
        return {"type": "kmeans", "classes": self.classes, "iterations": self.iterations, "tol": self.tol,
                "seed": self.seed, "dissimilarity": self.dissimilarity.to_dict()}


@dataclass(frozen=True)
class DBSCANMethod:
    """Points within ``radius``; ``min_neighbors`` others make a core point; smaller clusters are dropped."""

    radius: float
    min_neighbors: int = 1
    min_cluster_size: int = 1
    dissimilarity: Dissimilarity = field(default_factory=lambda: Dissimilarity("euclidean"))

    def __post_init__(self):
        if not self.radius > 0 or self.min_neighbors < 1 or self.min_cluster_size < 1:
            raise ValueError("dbscan: radius > 0, min_neighbors >= 1, min_cluster_size >= 1")
        if not self.dissimilarity.is_metric:
            raise ValueError(f"dbscan needs a true metric, not {self.dissimilarity.type!r}")

    def to_dict(self):
        return {"type": "dbscan", "radius": self.radius, "min_neighbors": self.min_neighbors,
                "min_cluster_size": self.min_cluster_size, "dissimilarity": self.dissimilarity.to_dict()}


CLUSTER_METHODS = {"kmeans": KMeansMethod, "dbscan": DBSCANMethod}


def finite_point(xs: list[Column]) -> Column:
    """The coordinates as one array; NULL if one is NULL, NaN or infinite."""
    arr = F.array(*xs)
    return F.when(F.forall(arr, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), arr)


@register_card("cluster", "Cluster")
@dataclass(frozen=True)
class ClusterCard(Card):
    """Cluster labels (1..k; dbscan: 0 is noise) for the training rows; other rows keep the column's old value (NULL if it is new).

    DBSCAN has no weights (they are ignored with a warning); rows with a NULL, NaN or infinite input get no label from it.
    """

    method: KMeansMethod | DBSCANMethod
    inputs: tuple
    weights: str | None = None
    partition: str | None = None
    output: str = "cluster"

    def __post_init__(self):
        object.__setattr__(self, "inputs", tuple(self.inputs))
        if not self.inputs:
            raise ValueError("cluster needs at least one input")

    @classmethod
    def from_config(cls, d):
        check_fields(cls, d)
        d = dict(d)
        name, params = method_of(d.pop("method"), list(CLUSTER_METHODS))
        if "dissimilarity" in params or "distance" in params:
            params["dissimilarity"] = Dissimilarity.from_config(params.pop("dissimilarity", params.pop("distance", None)))
        return cls(method=CLUSTER_METHODS[name](**params), **d)

    def source_variables(self):
        return SourceVariables(inputs=list(self.inputs), weights=[self.weights] if self.weights else [],
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables([self.output])

    def fit(self, df, id_var=None):
        m = self.method
        if isinstance(m, DBSCANMethod):
            return self._fit_dbscan(training_rows(df, self.partition), id_var)
        res = kmeans_fit(training_rows(df, self.partition), list(self.inputs), m.classes, weights=self.weights,
                         dist=m.dissimilarity, iterations=m.iterations, tol=m.tol, seed=m.seed)
        return CardState(content={"centres": res["centres"].tolist(), "iterations": res["iterations"],
                                  "objective": res["objective"], "converged": res["converged"]})

    def _fit_dbscan(self, train, id_var):
        m = self.method
        if self.weights:
            warnings.warn("dbscan ignores weights", stacklevel=3)
        number = qcol(id_var).cast("bigint") if id_var else F.monotonically_increasing_id()
        points = train.select(number.alias("id"), finite_point(feature_columns(train, list(self.inputs))).alias("x"))
        labels = dbscan_points(points.where(F.col("x").isNotNull()), m.radius, m.min_neighbors, m.min_cluster_size, m.dissimilarity)
        labels = reliable_checkpoint(labels)
        found = labels.agg(F.coalesce(F.max("label"), F.lit(0))).first()[0]
        return CardState(content={"clusters": found}, tables={"labels": labels})

    def _transform_dbscan(self, df, state):
        mine = F.lit(True) if self.partition is None else F.coalesce(qcol(self.partition) == 1, F.lit(False))
        point = finite_point(feature_columns(df, list(self.inputs)))
        old = qcol(self.output).cast("bigint") if self.output in df.columns else F.lit(None).cast("bigint")
        asked = df.select("*", F.when(mine, point).alias("_cd_x"), mine.alias("_cd_mine"))
        known = state.tables["labels"].select(F.col("x").alias("_cd_x"), F.col("label").alias("_cd_label"))
        out = F.when(F.col("_cd_mine"), F.col("_cd_label")).otherwise(old)
        keep = [qcol(c) for c in df.columns if c != self.output]
        return asked.join(known, "_cd_x", "left").select(*keep, out.alias(self.output))

    def transform(self, df, state, id_var=None):
        if isinstance(self.method, DBSCANMethod):
            return self._transform_dbscan(df, state)
        xs = feature_columns(df, list(self.inputs))
        lab = assign(xs, np.asarray(state.content["centres"]), self.method.dissimilarity)
        if self.partition:
            # Rows without a result keep the old value of an existing column.
            old = qcol(self.output).cast("bigint") if self.output in df.columns else F.lit(None).cast("bigint")
            lab = F.when(qcol(self.partition) == 1, lab).otherwise(old)
        keep = [qcol(c) for c in df.columns if c != self.output]
        return df.select(*keep, lab.cast("bigint").alias(self.output))

    def report(self, state):
        if isinstance(self.method, DBSCANMethod):
            return {"clusters": state.content.get("clusters")}
        return {k: state.content.get(k) for k in ("iterations", "objective", "converged")}

"""Dimensionality reduction cards.

The data is touched by two aggregations: the mean vector, then the centred
cross-product matrix (one d x d block per partition).  Everything else
(eigen decomposition, PPCA closed form, factor-analysis EM) works on the
d x d covariance on the driver, and scores are linear column expressions.

Rules (pinned by tests):
* covariance is the maximum-likelihood one (divided by n);
* each component's loading with the largest absolute value is positive;
* ``min(n_components, rank)`` components are kept, the rest are NULL;
* classical MDS from coordinates equals centred PCA scores (Gower duality).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import join_names, qcol
from cardinal.functions.partials import sum_partials
from cardinal.operators.filters import training_rows
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, method_of, register_card


def mean_and_covariance(df: DataFrame, xs: list[Column]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector and ML covariance of the complete rows, in two aggregation passes."""
    d = len(xs)
    feats = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    r = feats.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]).first()
    n = int(r["n"])
    if n == 0:
        raise ValueError("no complete rows to fit")
    mu = np.array([r[f"m{i}"] for i in range(d)], dtype=float)

    def kernel(batches):
        cross = np.zeros((d, d))
        for pdf in batches:
            cen = pdf.to_numpy(dtype=float) - mu
            cross += cen.T @ cen
        yield pd.DataFrame({"c": [cross.ravel().tolist()]})

    part = feats.mapInPandas(kernel, "c array<double>")
    cross, _ = sum_partials(part, feats.rdd.getNumPartitions(), {"c": d * d}, [])
    return mu, cross["c"].reshape(d, d) / n, n


def _sign_fix(V: np.ndarray) -> np.ndarray:
    """Flip columns so the largest-magnitude entry of each is positive."""
    V = V.copy()
    for j in range(V.shape[1]):
        i = int(np.argmax(np.abs(V[:, j])))
        if V[i, j] < 0:
            V[:, j] = -V[:, j]
    return V


def pca_params(cov: np.ndarray, k: int, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    rank = int((vals > tol * max(vals[0], tol)).sum())
    q = min(k, rank)
    return vals[:q], _sign_fix(vecs[:, :q])


def ppca_params(cov: np.ndarray, k: int) -> np.ndarray:
    """Projection matrix (d x q) giving posterior latent means (Tipping & Bishop 1999)."""
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    d = len(vals)
    q = min(k, d)
    sigma2 = float(vals[q:].mean()) if q < d else 0.0
    U = _sign_fix(vecs[:, :q])
    W = U * np.sqrt(np.maximum(vals[:q] - sigma2, 0.0))
    M = W.T @ W + sigma2 * np.eye(q)
    return (np.linalg.solve(M, W.T)).T


def fa_params(cov: np.ndarray, k: int, iterations: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Factor-analysis EM on the covariance (Rubin & Thayer 1982); returns the d x q score matrix."""
    d = cov.shape[0]
    q = min(k, d)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    W = vecs[:, order[:q]] * np.sqrt(np.maximum(vals[order[:q]], 1e-12))
    psi = np.maximum(np.diag(cov) - (W * W).sum(1), 1e-6 * np.maximum(np.diag(cov), 1e-12))
    prev = np.inf
    for _ in range(iterations):
        sigma = W @ W.T + np.diag(psi)
        beta = np.linalg.solve(sigma, W).T  # q x d
        Ezz = np.eye(q) - beta @ W + beta @ cov @ beta.T
        W = cov @ beta.T @ np.linalg.inv(Ezz)
        psi = np.maximum(np.diag(cov - W @ beta @ cov), 1e-12)
        sign, logdet = np.linalg.slogdet(W @ W.T + np.diag(psi))
        ll = logdet + np.trace(np.linalg.solve(W @ W.T + np.diag(psi), cov))
        if abs(prev - ll) < tol:
            break
        prev = ll
    W = _sign_fix(W)
    beta = np.linalg.solve(W @ W.T + np.diag(psi), W).T
    return beta.T


def project(xs: list[Column], mu: np.ndarray, P: np.ndarray, names: list[str]) -> list[Column]:
    """Columns ``names[j] = sum_i (x_i - mu_i) P[i, j]``; names beyond P's width are NULL."""
    out = []
    for j, name in enumerate(names):
        if j < P.shape[1]:
            expr = None
            for i, x in enumerate(xs):
                t = (x.cast("double") - F.lit(float(mu[i]))) * F.lit(float(P[i, j]))
                expr = t if expr is None else expr + t
            out.append(expr.alias(name))
        else:
            out.append(F.lit(None).cast("double").alias(name))
    return out


DR_METHODS = ("pca", "ppca", "factoranalysis", "mds")


@register_card("dimensionality_reduction", "Dimensionality reduction")
@dataclass(frozen=True)
class DimensionalityReductionCard(Card):
    method: str
    inputs: tuple
    n_components: int
    partition: str | None = None
    output: str = "component"
    iterations: int = 1000
    tol: float = 1e-6

    def __post_init__(self):
        object.__setattr__(self, "inputs", tuple(self.inputs))
        if self.method not in DR_METHODS:
            raise ValueError(f"unknown method {self.method!r}; valid: {', '.join(DR_METHODS)}")
        if self.n_components < 1 or self.iterations < 1 or self.tol <= 0:
            raise ValueError("n_components >= 1, iterations >= 1, tol > 0")

    @classmethod
    def from_config(cls, d):
        d = dict(d)
        name, params = method_of(d.pop("method"), list(DR_METHODS))
        check_fields(cls, d)
        return cls(method=name, **params, **d)

    def to_dict(self):
        out = super().to_dict()
        out["method"] = {"type": self.method}
        return out

    def outputs(self):
        return [join_names(self.output, i) for i in range(1, self.n_components + 1)]

    def source_variables(self):
        return SourceVariables(inputs=list(self.inputs), partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables(self.outputs())

    def fit(self, df, id_var=None):
        xs = [qcol(c) for c in self.inputs]
        mu, cov, n = mean_and_covariance(training_rows(df, self.partition), xs)
        if self.method in ("pca", "mds"):
            vals, P = pca_params(cov, self.n_components)
        elif self.method == "ppca":
            P, vals = ppca_params(cov, self.n_components), None
        else:
            P, vals = fa_params(cov, self.n_components, self.iterations, self.tol), None
        return CardState(content={"mean": mu.tolist(), "projection": P.tolist(), "n": n,
                                  "variances": None if vals is None else np.asarray(vals).tolist()})

    def transform(self, df, state, id_var=None):
        xs = [qcol(c) for c in self.inputs]
        P = np.asarray(state.content["projection"], dtype=float).reshape(len(xs), -1)
        outs = self.outputs()
        keep = [qcol(c) for c in df.columns if c not in outs]
        return df.select(*keep, *project(xs, np.asarray(state.content["mean"]), P, outs))

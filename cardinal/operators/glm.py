"""Linear and generalised linear model cards.

The design matrix is a list of Spark column expressions built from a
formula (intercept, numeric variables, dummy-coded categoricals with the
first sorted level dropped, crossings).  Fitting is iteratively reweighted
least squares where each iteration is *one* aggregation over the training
rows producing ``X'WX`` (p(p+1)/2 sums) and ``X'Wz`` (p sums); the p x p
solve happens on the driver.  The normal/identity model needs a single
pass.  Rows with a NULL in any model variable are skipped in the fit and
predicted as NULL.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import ieee_div, ieee_ln, join_names, qcol
from cardinal.functions.normal import norm_cdf, norm_ppf
from cardinal.operators.filters import training_rows
from cardinal.operators.summary import is_numerical
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, check_fields, register_card

MAX_LEVELS = 10_000


# -- probit helpers (no JVM builtin for the normal CDF / quantile): whole Arrow batches in numpy
@F.pandas_udf(T.DoubleType())
def _norm_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(norm_cdf(x.to_numpy(dtype=float)))


@F.pandas_udf(T.DoubleType())
def _norm_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(norm_ppf(p.to_numpy(dtype=float)))


_PI = math.pi
LOGIT_EDGE = 36.0


def _phi(eta: Column) -> Column:
    return F.exp(-eta * eta / 2.0) / math.sqrt(2 * _PI)


# link name -> (link(mu), linkinv(eta), dmu/deta(eta)); theta for negativebinomial.
# Divisions and logs are IEEE-safe so that a fitted value at 0 or 1 never
# raises under ANSI mode; such rows get infinite/NaN weights and drop out.
def link_fns(name: str, theta: float = 1.0):
    one = F.lit(1.0)
    div, ln = ieee_div, ieee_ln
    if name == "identity":
        return (lambda m: m), (lambda e: e), (lambda e: one)
    if name == "log":
        return (lambda m: ln(m)), (lambda e: F.exp(e)), (lambda e: F.exp(e))
    if name == "logit":
        # Beyond LOGIT_EDGE the fitted value is 0 or 1 to double precision; weight and derivative stay positive.
        edge = lambda e: F.greatest(F.least(e, F.lit(LOGIT_EDGE)), F.lit(-LOGIT_EDGE))
        small = lambda e: F.exp(-F.abs(edge(e)))
        return ((lambda m: ln(div(m, one - m))), (lambda e: div(one, one + F.exp(-edge(e)))),
                (lambda e: div(small(e), (one + small(e)) * (one + small(e)))))
    if name == "probit":
        return (lambda m: _norm_ppf(m)), (lambda e: _norm_cdf(e)), (lambda e: _phi(e))
    if name == "cloglog":
        return ((lambda m: ln(-ln(one - m))), (lambda e: one - F.exp(-F.exp(e))),
                (lambda e: F.exp(e - F.exp(e))))
    if name == "inverse":
        return (lambda m: div(one, m)), (lambda e: div(one, e)), (lambda e: div(-one, e * e))
    if name == "inversesquare":
        return ((lambda m: div(one, m * m)), (lambda e: div(one, F.sqrt(e))),
                (lambda e: F.lit(-0.5) * F.pow(e, -1.5)))
    if name == "sqrt":
        return (lambda m: F.sqrt(m)), (lambda e: e * e), (lambda e: F.lit(2.0) * e)
    if name == "cauchit":
        return ((lambda m: F.tan(F.lit(_PI) * (m - 0.5))), (lambda e: F.lit(0.5) + F.atan(e) / _PI),
                (lambda e: div(one, F.lit(_PI) * (one + e * e))))
    if name == "negativebinomial":
        t = F.lit(float(theta))
        return ((lambda m: ln(div(m, m + t))), (lambda e: div(t * F.exp(e), one - F.exp(e))),
                (lambda e: div(t * F.exp(e), (one - F.exp(e)) * (one - F.exp(e)))))
    raise ValueError(f"unknown link {name!r}")


# Families, their canonical links, and the links accepted.
FAMILIES = ("normal", "binomial", "gamma", "inversegaussian", "poisson")
CANONICAL = {"normal": "identity", "binomial": "logit", "gamma": "inverse",
             "inversegaussian": "inversesquare", "poisson": "log"}
LINKS = ("cauchit", "cloglog", "identity", "inverse", "inversesquare", "logit", "log",
         "negativebinomial", "probit", "sqrt")


def variance(family: str, mu: Column) -> Column:
    return {"normal": lambda m: F.lit(1.0), "binomial": lambda m: m * (1 - m), "poisson": lambda m: m,
            "gamma": lambda m: m * m, "inversegaussian": lambda m: m * m * m}[family](mu)


def _xlogy(y: Column, r: Column) -> Column:
    return F.when(y == 0, F.lit(0.0)).otherwise(y * ieee_ln(r))


def deviance_resid(family: str, y: Column, mu: Column) -> Column:
    div = ieee_div
    if family == "normal":
        return (y - mu) * (y - mu)
    if family == "binomial":
        return 2 * (_xlogy(y, div(y, mu)) + _xlogy(1 - y, div(1 - y, 1 - mu)))
    if family == "poisson":
        return 2 * (_xlogy(y, div(y, mu)) - (y - mu))
    if family == "gamma":
        return -2 * (ieee_ln(div(y, mu)) - div(y - mu, mu))
    return div((y - mu) * (y - mu), y * mu * mu)


def initial_mu(family: str, y: Column) -> Column:
    if family == "binomial":
        return (y + 0.5) / 2.0
    if family == "poisson":
        return y + 0.1
    return y


# -- formula -----------------------------------------------------------------------
def formula_variables(terms) -> list[str]:
    out: list[str] = []
    for t in terms:
        if isinstance(t, str):
            out.append(t)
        elif isinstance(t, (list, tuple)):
            out.extend(x for x in t if isinstance(x, str))
    return list(dict.fromkeys(out))


def has_intercept(terms) -> bool:
    nums = [t for t in terms if isinstance(t, (int, float)) and not isinstance(t, bool)]
    return not nums or any(n == 1 for n in nums) and not any(n == 0 for n in nums)


def design(df_train: DataFrame, terms) -> tuple[list[str], list[dict]]:
    """Resolve a formula into column specs ``{"name", "parts": [(var, level|None)]}``.

    Categorical levels come from the training rows (sorted, first dropped).
    """
    vars_ = formula_variables(terms)
    cats = [v for v in vars_ if not is_numerical(df_train.schema[v].dataType)]
    levels: dict[str, list] = {}
    for v in cats:
        cnt = df_train.select(qcol(v)).where(qcol(v).isNotNull()).distinct().count()
        if cnt > MAX_LEVELS:
            raise ValueError(f"{v!r} has {cnt} levels; too many to dummy-code")
        levels[v] = [r[0] for r in df_train.select(qcol(v)).where(qcol(v).isNotNull()).distinct().orderBy(v).collect()]

    def coding(v):
        if v in levels:
            return [[(v, lv)] for lv in levels[v][1:]]
        return [[(v, None)]]

    specs: list[list[tuple]] = []
    if has_intercept(terms):
        specs.append([])
    for t in terms:
        if isinstance(t, str):
            specs.extend(coding(t))
        elif isinstance(t, (list, tuple)):
            vs = [x for x in t if isinstance(x, str)]
            for r in range(1, len(vs) + 1):
                for combo in itertools.combinations(vs, r):
                    for parts in itertools.product(*[coding(v) for v in combo]):
                        specs.append([p for part in parts for p in part])
    seen, cols = set(), []
    for parts in specs:
        name = "(Intercept)" if not parts else " & ".join(v if lv is None else f"{v}: {lv}" for v, lv in parts)
        if name not in seen:
            seen.add(name)
            cols.append({"name": name, "parts": [[v, lv] for v, lv in parts]})
    return vars_, cols


def design_columns(specs: list[dict]) -> list[Column]:
    out = []
    for s in specs:
        e = F.lit(1.0)
        for v, lv in s["parts"]:
            term = qcol(v).cast("double") if lv is None else F.when(qcol(v) == F.lit(lv), 1.0).otherwise(0.0)
            e = e * term
        out.append(e)
    return out


def irls(df: DataFrame, X: list[Column], y: Column, w: Column, family: str, link: str, *,
         theta: float = 1.0, iterations: int = 30, tol: float = 1e-8) -> dict:
    """Fit by IRLS; each iteration is one aggregation job on the executors."""
    p = len(X)
    lk, linv, mu_eta = link_fns(link, theta)
    data = df.select(*[x.alias(f"x{i}") for i, x in enumerate(X)], y.cast("double").alias("y"),
                     w.cast("double").alias("w")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    xs = [F.col(f"x{i}") for i in range(p)]
    try:
        beta = None          # current iterate (None: start from the initial fitted values)
        prev = None          # last accepted (beta, deviance)
        dev = np.inf
        converged = False
        it = halvings = lost = 0
        while it < iterations:
            it += 1
            eta = lk(initial_mu(family, F.col("y"))) if beta is None else _linear(beta, xs)
            # Staged projections keep each generated expression small: eta,
            # then mu and dmu/deta, then the working weight and response.
            stage = data.select(*xs, "y", "w", eta.alias("eta"))
            stage = stage.select(*xs, "y", "w", "eta", linv(F.col("eta")).alias("mu"), mu_eta(F.col("eta")).alias("d"))
            stage = stage.select(*xs, "y", "w", "eta", "mu", "d", variance(family, F.col("mu")).alias("v"))
            wt = ieee_div(F.col("w") * F.col("d") * F.col("d"), F.col("v"))
            z = F.col("eta") + ieee_div(F.col("y") - F.col("mu"), F.col("d"))
            dres = F.col("w") * deviance_resid(family, F.col("y"), F.col("mu"))
            stage = stage.select(*xs, wt.alias("wt"), z.alias("z"), dres.alias("dres"))
            ok = ~(F.isnan("wt") | F.isnan("z") | (F.abs("wt") == float("inf")) | (F.abs("z") == float("inf")))
            wok = F.when(ok, F.col("wt"))
            # One pass: deviance of the current iterate and the next weighted system.
            aggs = [F.sum(wok * xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
            aggs += [F.sum(wok * xs[i] * F.col("z")).alias(f"b{i}") for i in range(p)]
            aggs += [F.sum("dres").alias("dev"), F.sum((~ok).cast("long")).alias("lost")]
            r = stage.agg(*aggs).first()
            if beta is not None:
                dev = float(r["dev"]) if r["dev"] is not None else np.inf
                if prev is not None and (not np.isfinite(dev) or dev > prev[1] + tol * (abs(prev[1]) + 0.1)):
                    halvings += 1  # step halving towards the last accepted iterate
                    if halvings > 20:
                        raise ValueError("GLM fit diverged (step halving failed)")
                    beta = (beta + prev[0]) / 2
                    continue
                if not np.isfinite(dev):
                    raise ValueError("GLM fit diverged (non-finite deviance)")
                converged = prev is not None and abs(dev - prev[1]) <= tol * (abs(dev) + 0.1)
                converged = converged or (family == "normal" and link == "identity")
                prev = (beta, dev)
                lost = int(r["lost"] or 0)
                halvings = 0
                if converged:
                    break
            A = np.zeros((p, p))
            b = np.zeros(p)
            for i in range(p):
                b[i] = r[f"b{i}"]
                for j in range(i, p):
                    A[i, j] = A[j, i] = r[f"a{i}_{j}"]
            beta = np.linalg.lstsq(A, b, rcond=None)[0]
        if lost:
            raise ValueError(f"GLM fit: {lost} rows have no finite working weight at the fitted values")
        final = prev[0] if prev is not None else beta
        return {"coef": np.asarray(final).tolist(), "deviance": float(prev[1]) if prev else float("nan"),
                "iterations": it, "converged": converged}
    finally:
        data.unpersist()


def _linear(beta, xs) -> Column:
    eta = F.lit(float(beta[0])) * xs[0]
    for b, x in zip(beta[1:], xs[1:]):
        eta = eta + F.lit(float(b)) * x
    return eta


@register_card("glm", "GLM")
@dataclass(frozen=True)
class GLMCard(Card):
    """``target_hat = linkinv(X beta)`` with X from ``formula`` (list of terms)."""

    target: str
    formula: tuple
    distribution: str = "normal"
    link: str | None = None
    weights: str | None = None
    partition: str | None = None
    suffix: str = "hat"
    theta: float = 1.0
    iterations: int = 30

    def __post_init__(self):
        object.__setattr__(self, "formula", tuple(tuple(t) if isinstance(t, list) else t for t in self.formula))
        if self.distribution not in FAMILIES:
            raise ValueError(f"unknown distribution {self.distribution!r}; valid: {', '.join(FAMILIES)}")
        if self.link is not None and self.link not in LINKS:
            raise ValueError(f"unknown link {self.link!r}; valid: {', '.join(LINKS)}")
        if not self.target or not formula_variables(self.formula) and not self.formula:
            raise ValueError("glm needs a target and inputs")

    @classmethod
    def from_config(cls, d):
        d = dict(d)
        if "formula" in d and isinstance(d["formula"], dict):
            f = d.pop("formula")
            d["target"] = f["target"]
            d["formula"] = f["inputs"] if "inputs" in f else f["terms"]
        check_fields(cls, d)
        return cls(**d)

    def to_dict(self):
        out = super().to_dict()
        out["formula"] = [list(t) if isinstance(t, tuple) else t for t in self.formula]
        return out

    @property
    def link_name(self) -> str:
        return self.link or CANONICAL[self.distribution]

    @property
    def output(self) -> str:
        return join_names(self.target, self.suffix)

    def source_variables(self):
        return SourceVariables(inputs=formula_variables(self.formula), targets=[self.target],
                               weights=[self.weights] if self.weights else [],
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables([self.output])

    def fit(self, df, id_var=None):
        train = training_rows(df, self.partition)
        vars_, specs = design(train, list(self.formula))
        X = design_columns(specs)
        w = qcol(self.weights) if self.weights else F.lit(1.0)
        complete = train.dropna(subset=vars_ + [self.target] + ([self.weights] if self.weights else []))
        res = irls(complete, X, qcol(self.target), w, self.distribution, self.link_name, theta=self.theta,
                   iterations=self.iterations)
        cat_levels = {v: sorted(r[0] for r in complete.select(qcol(v)).distinct().collect())
                      for v in vars_ if not is_numerical(complete.schema[v].dataType)}
        return CardState(content={"coef": res["coef"], "columns": specs, "deviance": res["deviance"], "levels": cat_levels,
                                  "iterations": res["iterations"], "converged": res["converged"]})

    def transform(self, df, state, id_var=None):
        specs = state.content["columns"]
        X = design_columns(specs)
        eta = None
        for b, x in zip(state.content["coef"], X):
            t = F.lit(float(b)) * x
            eta = t if eta is None else eta + t
        _, linv, _ = link_fns(self.link_name, self.theta)
        vars_ = formula_variables(self.formula)
        ok = F.lit(True)
        for v in vars_:
            ok = ok & qcol(v).isNotNull()
        # A category level unseen in training has no coefficient: NULL prediction.
        for v, lvls in state.content.get("levels", {}).items():
            ok = ok & qcol(v).isin(list(lvls))
        pred = F.when(ok, linv(eta)).cast("double")
        keep = [qcol(c) for c in df.columns if c != self.output]
        return df.select(*keep, pred.alias(self.output))

    def report(self, state):
        return {"coef": dict(zip([c["name"] for c in state.content["columns"]], state.content["coef"])),
                "deviance": state.content.get("deviance"), "converged": state.content.get("converged")}

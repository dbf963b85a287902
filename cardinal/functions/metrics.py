"""Metrics and losses over (prediction, target) columns.

Each metric is a per-row column expression plus the number of elements it
stands for, so ``agg="mean"`` and ``agg="sum"`` are one distributed
aggregation.  Layout follows the usual "classes along the first axis"
convention: elementwise losses average over every output of every row;
class losses (``crossentropy`` and friends) sum over the classes of a row
and average over rows.  Predictions/targets are lists of numeric columns
(one per output or class).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardinal.functions.columns import ieee_div, ieee_ln, qcol

# Fixed value: default epsilon of single-precision training (eps(Float32)).
EPS = 1.1920929e-07


def _sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * ieee_ln(y))


def _logsigmoid(x: Column) -> Column:
    # -softplus(-x), stable for large |x|
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def _argmax(cols: Sequence[Column]) -> Column:
    arr = F.array(*[c.cast("double") for c in cols])
    return F.array_position(arr, F.array_max(arr))


def _logsoftmax(cols: Sequence[Column]) -> list[Column]:
    m = F.greatest(*cols) if len(cols) > 1 else cols[0]
    lse = m + ieee_ln(_sum([F.exp(c - m) for c in cols]))
    return [c - lse for c in cols]


ELEMENTWISE = ("mae", "mse", "msle", "huber_loss", "binarycrossentropy", "logitbinarycrossentropy",
               "poisson_loss", "hinge_loss", "squared_hinge_loss", "binary_focal_loss", "siamese_contrastive_loss")
PER_SAMPLE = ("accuracy", "crossentropy", "logitcrossentropy", "kldivergence", "focal_loss")
METRICS = ELEMENTWISE + PER_SAMPLE

# Metrics added by users (U5): name -> fn(predictions, targets) -> (sum of a row's terms, terms per row).
_USER_METRICS: dict = {}


def register_metric(name: str, fn) -> None:
    """Add a metric: ``fn(pred, target)`` on lists of double columns gives the sum of a row's terms and how many they are."""
    if name in METRICS:
        raise ValueError(f"{name!r} is a metric of the library")
    _USER_METRICS[name] = fn


def metric_names() -> tuple[str, ...]:
    return METRICS + tuple(_USER_METRICS)


def metric_terms(name: str, pred: Sequence[Column], target: Sequence[Column], *, eps: float = EPS,
                 delta: float = 1.0, gamma: float = 2.0, margin: float = 1.0) -> tuple[Column, int]:
    """Per-row sum of the metric's terms and the number of terms per row."""
    p = [c.cast("double") for c in pred]
    y = [c.cast("double") for c in target]
    k = len(p)
    e = F.lit(float(eps))
    if name in _USER_METRICS:
        return _USER_METRICS[name](p, y)
    if name in ELEMENTWISE:
        terms = []
        for a, b in zip(p, y):
            if name == "mae":
                t = F.abs(a - b)
            elif name == "mse":
                t = (a - b) * (a - b)
            elif name == "msle":
                t = F.pow(ieee_ln(ieee_div(a + e, b + e)), 2)
            elif name == "huber_loss":
                err = F.abs(a - b)
                t = F.when(err < delta, 0.5 * err * err).otherwise(delta * (err - 0.5 * delta))
            elif name == "binarycrossentropy":
                t = -_xlogy(b, a + e) - _xlogy(1 - b, 1 - a + e)
            elif name == "logitbinarycrossentropy":
                t = (1 - b) * a - _logsigmoid(a)
            elif name == "poisson_loss":
                t = a - _xlogy(b, a)
            elif name == "hinge_loss":
                t = F.greatest(F.lit(0.0), 1 - a * b)
            elif name == "squared_hinge_loss":
                t = F.pow(F.greatest(F.lit(0.0), 1 - a * b), 2)
            elif name == "binary_focal_loss":
                pe = a + e
                pt = b * pe + (1 - b) * (1 - pe)
                t = F.pow(1 - pt, gamma) * -ieee_ln(pt)
            else:  # siamese_contrastive_loss
                t = (1 - b) * a * a + b * F.pow(F.greatest(F.lit(0.0), margin - a), 2)
            terms.append(t)
        return _sum(terms), k
    if name == "accuracy":
        return F.when(_argmax(p) == _argmax(y), F.lit(1.0)).otherwise(F.lit(0.0)), 1
    if name == "crossentropy":
        return -_sum([_xlogy(b, a + e) for a, b in zip(p, y)]), 1
    if name == "logitcrossentropy":
        return -_sum([b * ls for ls, b in zip(_logsoftmax(p), y)]), 1
    if name == "kldivergence":
        ent = _sum([_xlogy(b, b) for b in y])
        return ent - _sum([_xlogy(b, a + e) for a, b in zip(p, y)]), 1
    if name == "focal_loss":
        return _sum([-b * F.pow(1 - (a + e), gamma) * ieee_ln(a + e) for a, b in zip(p, y)]), 1
    raise ValueError(f"unknown metric {name!r}; valid: {', '.join(metric_names())}")


def metric_column(name: str, pred: Sequence[Column], target: Sequence[Column], agg: str = "mean",
                  **params) -> Column:
    """Aggregate column for one metric over the rows of a frame."""
    terms, k = metric_terms(name, pred, target, **params)
    if agg == "sum":
        return F.sum(terms)
    if agg == "mean":
        return ieee_div(F.sum(terms), F.count(terms) * F.lit(float(k)))
    raise ValueError("agg must be mean or sum")


def evaluate_metrics(df: DataFrame, pred: Sequence[str], target: Sequence[str], metrics: Sequence[str],
                     agg: str = "mean", batch: str | None = None, **params) -> DataFrame:
    """One row with a column per metric.

    With ``batch``, each metric is computed per batch and then averaged over
    batches (the mean-of-batch-metrics rule).
    """
    pc = [qcol(c) for c in pred]
    tc = [qcol(c) for c in target]
    cols = [metric_column(m, pc, tc, agg, **params).alias(m) for m in metrics]
    if batch is None:
        return df.agg(*cols)
    per_batch = df.groupBy(qcol(batch)).agg(*cols)
    return per_batch.agg(*[F.avg(m).alias(m) for m in metrics])


def vae_loss_column(pred: Sequence[Column], source: Sequence[Column], mu: Sequence[Column], logvar: Sequence[Column],
                    agg: str = "mean", beta: float = 1.0) -> Column:
    """Aggregate column of the variational loss: reconstruction + ``beta`` * divergence from the unit normal.

    ``pred`` reconstructs ``source``; ``mu`` and ``logvar`` are the heads of
    the latent distribution.  With ``agg="mean"`` the squared errors are averaged over all
    elements and the divergences, summed over a row's latent numbers, over
    rows; with ``"sum"`` both are added up.  A row with a NULL in any of the
    columns is left out; no rows give NaN for the mean and NULL for the sum.
    """
    if len(pred) != len(source) or len(mu) != len(logvar) or not pred or not mu:
        raise ValueError("as many predictions as sources and as many means as log-variances, at least one each")
    p, x, m, v = ([c.cast("double") for c in cols] for cols in (pred, source, mu, logvar))
    square = _sum([(a - b) * (a - b) for a, b in zip(p, x)])
    divergence = _sum([(F.exp(lv) + a * a - 1 - lv) / 2 for a, lv in zip(m, v)])
    whole = (square + divergence).isNotNull()
    square, divergence = F.when(whole, square), F.when(whole, divergence)
    if agg == "sum":
        return F.sum(square) + float(beta) * F.sum(divergence)
    if agg == "mean":
        rows = F.count(square)
        return (ieee_div(F.coalesce(F.sum(square), F.lit(0.0)), rows * F.lit(float(len(p))))
                + float(beta) * ieee_div(F.coalesce(F.sum(divergence), F.lit(0.0)), rows.cast("double")))
    raise ValueError("agg must be mean or sum")


def evaluate_vae_loss(df: DataFrame, pred: Sequence[str], source: Sequence[str], mu: Sequence[str], logvar: Sequence[str],
                      agg: str = "mean", beta: float = 1.0, batch: str | None = None) -> DataFrame:
    """One row with ``vae_loss``; with ``batch`` the mean of the batches' losses."""
    loss = vae_loss_column(*[[qcol(c) for c in cols] for cols in (pred, source, mu, logvar)], agg, beta).alias("vae_loss")
    if batch is None:
        return df.agg(loss)
    return df.groupBy(qcol(batch)).agg(loss).agg(F.avg("vae_loss").alias("vae_loss"))


def label_smoothing(target: Sequence[Column], alpha: float, binary: bool = False) -> list[Column]:
    """Smoothed targets: ``y (1 - a) + a / k`` (``a / 2`` for binary targets)."""
    k = 2 if binary else len(target)
    return [c.cast("double") * (1 - alpha) + alpha / k for c in target]

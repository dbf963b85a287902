"""Dense neural-network card trained data-parallel on Spark.

Training is synchronous data-parallel gradient descent:

* the assembled split (input vector, target vector) is persisted once;
* each optimizer step is one Spark job: ``mapInPandas`` runs the forward and
  backward pass in numpy over each partition's Arrow batches and emits one
  row per partition (loss sum, row count, flattened gradient sum);
* they are added in two steps (`functions.partials`) and the driver applies regularisation, the learning-rate
  schedule and the optimizer rule, and broadcasts the new weights by closure.

An epoch is ``batches`` global steps over a seeded hash split of the
training rows (one step per batch, the whole split by default); the
validation loss is computed after each epoch and the best weights are kept.
Trajectories differ from per-32-row training by design; gradients, losses
and metrics are exact.  Prediction is JVM-side: one projection of column
expressions per dense layer.
"""

from __future__ import annotations

import copy
import dataclasses
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import join_names, qcol
from cardinal.functions.metrics import metric_column, metric_names
from cardinal.functions.partials import sum_partials
from cardinal.operators.filters import split_rows
from cardinal.operators.optim import descend
from cardinal.operators.funnel import levels as level_list
from cardinal.operators.funnels import Funnel, funnel_from_dict
from cardinal.operators.summary import is_numerical
from cardinal.plans.card import Card, CardState, OutputVariables, SourceVariables, register_card

# -- activations (N13): name -> (f, f') ---------------------------------------------


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softplus(x):
    return np.logaddexp(0, x)


_SELU_A, _SELU_L = 1.6732632423543772, 1.0507009873554805

ACTIVATIONS = {
    "identity": (lambda x: x, lambda x: np.ones_like(x)),
    "relu": (lambda x: np.maximum(x, 0), lambda x: (x > 0).astype(float)),
    "relu6": (lambda x: np.clip(x, 0, 6), lambda x: ((x > 0) & (x < 6)).astype(float)),
    "leakyrelu": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x: np.where(x > 0, 1.0, 0.01)),
    "rrelu": (lambda x: np.where(x > 0, x, x * (1 / 8 + 1 / 3) / 2), lambda x: np.where(x > 0, 1.0, (1 / 8 + 1 / 3) / 2)),
    "elu": (lambda x: np.where(x > 0, x, np.expm1(x)), lambda x: np.where(x > 0, 1.0, np.exp(x))),
    "celu": (lambda x: np.where(x > 0, x, np.expm1(x)), lambda x: np.where(x > 0, 1.0, np.exp(x))),
    "selu": (lambda x: _SELU_L * np.where(x > 0, x, _SELU_A * np.expm1(x)),
             lambda x: _SELU_L * np.where(x > 0, 1.0, _SELU_A * np.exp(x))),
    "gelu": (lambda x: 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x ** 3))),
             lambda x: 0.5 * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x ** 3)))
             + 0.5 * x * (1 - np.tanh(0.7978845608028654 * (x + 0.044715 * x ** 3)) ** 2)
             * 0.7978845608028654 * (1 + 3 * 0.044715 * x ** 2)),
    "sigmoid": (_sigmoid, lambda x: _sigmoid(x) * (1 - _sigmoid(x))),
    "hardsigmoid": (lambda x: np.clip(x / 6 + 0.5, 0, 1), lambda x: ((x > -3) & (x < 3)) / 6.0),
    "tanh": (np.tanh, lambda x: 1 - np.tanh(x) ** 2),
    "hardtanh": (lambda x: np.clip(x, -1, 1), lambda x: ((x > -1) & (x < 1)).astype(float)),
    "softplus": (_softplus, _sigmoid),
    "softsign": (lambda x: x / (1 + np.abs(x)), lambda x: 1 / (1 + np.abs(x)) ** 2),
    "softshrink": (lambda x: np.where(x > 0.5, x - 0.5, np.where(x < -0.5, x + 0.5, 0.0)),
                   lambda x: (np.abs(x) > 0.5).astype(float)),
    "logsigmoid": (lambda x: -_softplus(-x), lambda x: 1 - _sigmoid(x)),
    "logcosh": (lambda x: x + _softplus(-2 * x) - math.log(2), lambda x: np.tanh(x)),
    "lisht": (lambda x: x * np.tanh(x), lambda x: np.tanh(x) + x * (1 - np.tanh(x) ** 2)),
    "swish": (lambda x: x * _sigmoid(x), lambda x: _sigmoid(x) + x * _sigmoid(x) * (1 - _sigmoid(x))),
    "tanhshrink": (lambda x: x - np.tanh(x), lambda x: np.tanh(x) ** 2),
    "trelu": (lambda x: np.where(x > 1, x, 0.0), lambda x: (x > 1).astype(float)),
}


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _logsumexp(z):
    top = z.max(1, keepdims=True)
    return top + np.log(np.exp(z - top).sum(1, keepdims=True))


# Heads over a whole layer (N14): name -> (f, (pre-activation, output, gradient) -> gradient of the pre-activation).
# logsumexp makes one output of all units.
HEADS = {
    "softmax": (_softmax, lambda z, h, g: h * (g - (g * h).sum(1, keepdims=True))),
    "logsoftmax": (lambda z: z - _logsumexp(z), lambda z, h, g: g - np.exp(h) * g.sum(1, keepdims=True)),
    "logsumexp": (_logsumexp, lambda z, h, g: g * np.exp(z - h)),
}


def head_exprs(name: str, zs: list) -> list:
    """The heads as column expressions of the layer's pre-activations."""
    top = F.greatest(*zs) if len(zs) > 1 else zs[0]
    total = sum((F.exp(z - top) for z in zs[1:]), F.exp(zs[0] - top))
    if name == "logsumexp":
        return [top + F.log(total)]
    return [F.exp(z - top) / total if name == "softmax" else z - top - F.log(total) for z in zs]


# Plug-in registries (U5, N4): user activations and input transforms.
_USER_EXPR: dict = {}
TRANSFORMS: dict = {"identity": lambda c: c}


def register_activation(name: str, f, df, expr) -> None:
    """Add an activation: numpy ``f`` and derivative ``df`` for training, Column ``expr`` for prediction."""
    ACTIVATIONS[name] = (f, df)
    _USER_EXPR[name] = expr


def register_transform(name: str, fn) -> None:
    """Add an input column transform (Column -> Column), applied before assembly."""
    TRANSFORMS[name] = fn


def activation_expr(name: str, z):
    """The same activations as Spark column expressions (for prediction)."""
    if name in _USER_EXPR:
        return _USER_EXPR[name](z)
    one, zero = F.lit(1.0), F.lit(0.0)
    sig = lambda v: one / (one + F.exp(-v))
    softplus = lambda v: F.greatest(v, zero) + F.log1p(F.exp(-F.abs(v)))
    if name == "identity":
        return z
    if name == "relu":
        return F.greatest(z, zero)
    if name == "relu6":
        return F.least(F.greatest(z, zero), F.lit(6.0))
    if name == "leakyrelu":
        return F.when(z > 0, z).otherwise(z * 0.01)
    if name == "rrelu":
        return F.when(z > 0, z).otherwise(z * ((1 / 8 + 1 / 3) / 2))
    if name in ("elu", "celu"):
        return F.when(z > 0, z).otherwise(F.expm1(z))
    if name == "selu":
        return F.when(z > 0, z * _SELU_L).otherwise(F.expm1(z) * (_SELU_L * _SELU_A))
    if name == "gelu":
        return z * 0.5 * (one + F.tanh((z + F.pow(z, 3) * 0.044715) * 0.7978845608028654))
    if name == "sigmoid":
        return sig(z)
    if name == "hardsigmoid":
        return F.least(F.greatest(z / 6.0 + 0.5, zero), one)
    if name == "tanh":
        return F.tanh(z)
    if name == "hardtanh":
        return F.least(F.greatest(z, F.lit(-1.0)), one)
    if name == "softplus":
        return softplus(z)
    if name == "softsign":
        return z / (one + F.abs(z))
    if name == "softshrink":
        return F.when(z > 0.5, z - 0.5).when(z < -0.5, z + 0.5).otherwise(zero)
    if name == "logsigmoid":
        return -softplus(-z)
    if name == "logcosh":
        return z + softplus(z * -2.0) - math.log(2)
    if name == "lisht":
        return z * F.tanh(z)
    if name == "swish":
        return z * sig(z)
    if name == "tanhshrink":
        return z - F.tanh(z)
    if name == "trelu":
        return F.when(z > 1, z).otherwise(zero)
    raise ValueError(f"unknown activation {name!r}")


# -- network ----------------------------------------------------------------------

def init_params(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    """Glorot-uniform weights, zero biases, as [W1, b1, W2, b2, ...]."""
    rng = np.random.default_rng(seed)
    params = []
    for i, o in zip(sizes[:-1], sizes[1:]):
        lim = math.sqrt(6 / (i + o))
        params += [rng.uniform(-lim, lim, size=(i, o)), np.zeros(o)]
    return params


def flatten(params):
    return np.concatenate([p.ravel() for p in params])


def unflatten(vec, like):
    out, k = [], 0
    for p in like:
        out.append(vec[k:k + p.size].reshape(p.shape))
        k += p.size
    return out


def forward(params, acts, X, table: dict | None = None):
    """Layer outputs and pre-activations; ``table`` maps activation names to (f, f')."""
    table = table or ACTIVATIONS
    hs, zs = [X], []
    h = X
    for li in range(len(acts)):
        z = h @ params[2 * li] + params[2 * li + 1]
        zs.append(z)
        h = HEADS[acts[li]][0](z) if acts[li] in HEADS else table[acts[li]][0](z)
        hs.append(h)
    return hs, zs


def _sign(x):
    return np.sign(x)


# Training losses: (outputs, targets) -> (sum over rows, gradient).  Elementwise ones average over the outputs.
def _elementwise(value, slope):
    return lambda out, Y: (float(value(out, Y).sum()) / Y.shape[1], slope(out, Y) / Y.shape[1])


def _logit_cross_entropy(out, Y):
    m = out.max(1, keepdims=True)
    lse = m + np.log(np.exp(out - m).sum(1, keepdims=True))
    return float(-(Y * (out - lse)).sum()), np.exp(out - lse) * Y.sum(1, keepdims=True) - Y


LOSSES: dict = {
    "mse": _elementwise(lambda o, y: (o - y) ** 2, lambda o, y: 2 * (o - y)),
    "mae": _elementwise(lambda o, y: np.abs(o - y), lambda o, y: _sign(o - y)),
    "huber_loss": _elementwise(lambda o, y: np.where(np.abs(o - y) < 1, 0.5 * (o - y) ** 2, np.abs(o - y) - 0.5),
                               lambda o, y: np.clip(o - y, -1, 1)),
    "poisson_loss": _elementwise(lambda o, y: o - np.where(y == 0, 0.0, y * np.log(np.where(y == 0, 1.0, o))),
                                 lambda o, y: 1 - np.where(y == 0, 0.0, y / np.where(y == 0, 1.0, o))),
    "logitbinarycrossentropy": _elementwise(lambda o, y: (1 - y) * o + _softplus(-o), lambda o, y: _sigmoid(o) - y),
    "logitcrossentropy": _logit_cross_entropy,
}


def register_loss(name: str, fn) -> None:
    """Add a training loss: ``fn(outputs, targets) -> (sum over rows, gradient)`` on numpy matrices."""
    LOSSES[name] = fn


def loss_and_grad(params, acts, X, Y, loss, need_grad: bool = True, table: dict | None = None, losses: dict | None = None):
    """Summed loss over rows and gradient of that sum.

    ``loss`` is a name, or ``(start, stop, name)`` triples, one for each
    target's outputs, whose losses add up.
    """
    table, losses = table or ACTIVATIONS, losses or LOSSES
    hs, zs = forward(params, acts, X, table)
    out = hs[-1]
    total, g = 0.0, np.zeros_like(out)
    for start, stop, name in [(0, out.shape[1], loss)] if isinstance(loss, str) else loss:
        if name not in losses:
            raise ValueError(f"unsupported training loss {name!r}; valid: {', '.join(losses)}")
        part, g[:, start:stop] = losses[name](out[:, start:stop], Y[:, start:stop])
        total += part
    if not need_grad:
        return total, None
    grads = [None] * len(params)
    for li in reversed(range(len(acts))):
        if acts[li] in HEADS:
            g = HEADS[acts[li]][1](zs[li], hs[li + 1], g)
        else:
            g = g * table[acts[li]][1](zs[li])
        grads[2 * li] = hs[li].T @ g
        grads[2 * li + 1] = g.sum(0)
        g = g @ params[2 * li].T
    return total, grads


# -- optimizers (N15) and schedules (N17) --------------------------------------------

# Optimizers and schedules added by users.
_USER_OPTIMIZERS: dict = {}
_USER_SCHEDULES: dict = {}


def register_optimizer(name: str, factory) -> None:
    """Add a first-order optimizer: ``factory(training)`` gives an object with ``step(weights, gradient, eta) -> weights``.

    The weights are one flat numpy vector; ``eta`` is the schedule's value, or None without a schedule.
    """
    if name.lower() in (*Optimizer.RULES, *FULL_BATCH):
        raise ValueError(f"{name!r} is an optimizer of the library")
    _USER_OPTIMIZERS[name] = factory


def register_schedule(name: str, fn) -> None:
    """Add a learning-rate schedule: ``fn(step from 1, parameters) -> rate``."""
    if name in SCHEDULES:
        raise ValueError(f"{name!r} is a schedule of the library")
    _USER_SCHEDULES[name] = fn


class Optimizer:
    """First-order update rules on the flat parameter vector."""

    RULES = ("descent", "momentum", "nesterov", "rmsprop", "adam", "radam", "adamax", "adagrad", "adadelta",
             "amsgrad", "nadam", "adamw", "oadam", "adabelief")

    def __init__(self, rule: str = "adam", eta: float = 1e-3, rho: float = 0.9, beta=(0.9, 0.999),
                 eps: float = 1e-8, decay: float = 0.0):
        if rule.lower() not in self.RULES:
            raise ValueError(f"unknown optimizer {rule!r}; valid: {', '.join(self.RULES)}")
        self.rule, self.eta, self.rho, self.beta, self.eps, self.decay = rule.lower(), eta, rho, beta, eps, decay
        self.state: dict = {}
        self.t = 0

    def step(self, w: np.ndarray, g: np.ndarray, eta: float | None = None) -> np.ndarray:
        eta = self.eta if eta is None else eta
        s, b1, b2, eps, r = self.state, self.beta[0], self.beta[1], self.eps, self.rule
        self.t += 1
        t = self.t
        m = s.setdefault("m", np.zeros_like(w))
        v = s.setdefault("v", np.zeros_like(w))
        if r == "descent":
            return w - eta * g
        if r == "momentum":
            s["m"] = self.rho * m - eta * g
            return w + s["m"]
        if r == "nesterov":
            new_m = self.rho * m - eta * g
            s["m"] = new_m
            return w - self.rho * m + (1 + self.rho) * new_m
        if r == "rmsprop":
            s["v"] = self.rho * v + (1 - self.rho) * g * g
            return w - eta * g / (np.sqrt(s["v"]) + eps)
        if r == "adagrad":
            s["v"] = v + g * g
            return w - eta * g / (np.sqrt(s["v"]) + eps)
        if r == "adadelta":
            s["v"] = self.rho * v + (1 - self.rho) * g * g
            d = np.sqrt(m + eps) / np.sqrt(s["v"] + eps) * g
            s["m"] = self.rho * m + (1 - self.rho) * d * d
            return w - d
        s["m"] = b1 * m + (1 - b1) * g
        if r == "adabelief":
            s["v"] = b2 * v + (1 - b2) * (g - s["m"]) ** 2
        elif r == "adamax":
            s["v"] = np.maximum(b2 * v, np.abs(g))
        else:
            s["v"] = b2 * v + (1 - b2) * g * g
        mh = s["m"] / (1 - b1 ** t)
        vh = s["v"] / (1 - b2 ** t)
        if r in ("adam", "adabelief"):
            return w - eta * mh / (np.sqrt(vh) + eps)
        if r == "adamw":
            return w - eta * (mh / (np.sqrt(vh) + eps) + self.decay * w)
        if r == "adamax":
            return w - eta * mh / (s["v"] + eps)
        if r == "amsgrad":
            s["vmax"] = np.maximum(s.get("vmax", np.zeros_like(w)), s["v"])
            return w - eta * s["m"] / (np.sqrt(s["vmax"]) + eps)
        if r == "nadam":
            return w - eta * (b1 * mh + (1 - b1) * g / (1 - b1 ** t)) / (np.sqrt(vh) + eps)
        if r == "oadam":
            prev = s.get("prev", np.zeros_like(w))
            upd = eta * mh / (np.sqrt(vh) + eps)
            s["prev"] = upd
            return w - 2 * upd + prev
        # radam
        rho_inf = 2 / (1 - b2) - 1
        rho_t = rho_inf - 2 * t * b2 ** t / (1 - b2 ** t)
        if rho_t > 4:
            rt = math.sqrt((rho_t - 4) * (rho_t - 2) * rho_inf / ((rho_inf - 4) * (rho_inf - 2) * rho_t))
            return w - eta * rt * mh / (np.sqrt(vh) + eps)
        return w - eta * mh


SCHEDULES = ("step", "exp", "poly", "inv", "triangle", "triangledecay2", "triangleexp", "sin", "sindecay2",
             "sinexp", "cosanneal")


def schedule_value(name: str, t: int, p: dict) -> float:
    """Learning rate at iteration ``t`` (1-based) for a named schedule."""
    if name in _USER_SCHEDULES:
        return float(_USER_SCHEDULES[name](t, p))
    s0 = p.get("start", p.get("l0", 1e-2))
    period = max(1, int(p.get("period", 10)))
    decay = p.get("decay", 0.5)
    lo = p.get("l1", s0 / 10)
    frac = ((t - 1) % period) / period
    tri = 1 - abs(2 * frac - 1)
    sine = abs(math.sin(math.pi * (t - 1) / period))
    if name == "step":
        return s0 * decay ** ((t - 1) // period)
    if name == "exp":
        return s0 * decay ** (t - 1)
    if name == "poly":
        return s0 * (1 - (t - 1) / p.get("max_iter", 100)) ** p.get("degree", 1)
    if name == "inv":
        return s0 / (1 + p.get("gamma", 0.1) * (t - 1)) ** p.get("power", 1)
    if name in ("triangle", "sin"):
        return lo + (s0 - lo) * (tri if name == "triangle" else sine)
    if name in ("triangledecay2", "sindecay2"):
        return lo + (s0 - lo) * (tri if name == "triangledecay2" else sine) / 2 ** ((t - 1) // period)
    if name in ("triangleexp", "sinexp"):
        return lo + (s0 - lo) * (tri if name == "triangleexp" else sine) * decay ** (t - 1)
    if name == "cosanneal":
        return lo + (s0 - lo) * (1 + math.cos(math.pi * ((t - 1) % period) / period)) / 2
    raise ValueError(f"unknown schedule {name!r}; valid: {', '.join((*SCHEDULES, *_USER_SCHEDULES))}")


# -- Spark jobs ----------------------------------------------------------------------

_GRAD_SCHEMA = T.StructType([T.StructField("loss", T.DoubleType()), T.StructField("n", T.LongType()),
                             T.StructField("g", T.ArrayType(T.DoubleType()))])


def matrices(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The array columns of a batch of :func:`assemble` as matrices, without a Python object per row."""
    return [c.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1) for c in batch.columns]


_IDENTITY, _MSE = ACTIVATIONS["identity"], LOSSES["mse"]  # as built in
FOLD_WIDTH = 256  # inputs, bias and targets of a network that is folded: the square of it is one partition's result


def folds(acts, loss) -> bool:
    """True if the loss is a sum of squares of a linear function of the weights: one identity layer under mse."""
    same = ACTIVATIONS.get("identity") is _IDENTITY and LOSSES["mse"] is _MSE
    return same and list(acts) == ["identity"] and all(name == "mse" for *_, name in loss)


@dataclass(frozen=True)
class Folded:
    """The triangular factor of the rows (x, 1, y): its few rows have the summed squared loss of all rows, at any weights.

    One pass over the rows, a factor per batch added to the one before; loss
    and gradient at new weights then read no row again.
    """

    r: np.ndarray
    n: int

    @classmethod
    def of(cls, data: DataFrame, width: int) -> Folded:
        def factor(rows: list) -> np.ndarray:
            got = np.linalg.qr(np.vstack(rows), mode="r")
            return np.vstack([got, np.zeros((width - len(got), width))])

        def kernel(it):
            r, n = np.zeros((width, width)), 0
            for batch in it:
                if batch.num_rows:
                    X, Y = matrices(batch)
                    r, n = factor([r, np.column_stack([X, np.ones(len(X)), Y])]), n + len(X)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["n", "r"])

        def joined(it):
            r, n = np.zeros((width, width)), 0
            for pdf in it:
                for k, one in zip(pdf["n"], pdf["r"], strict=True):
                    r, n = factor([r, np.reshape(one, (width, width))]), n + int(k)
            yield pd.DataFrame({"n": [n], "r": [r.ravel().tolist()]})

        part = data.select("x", "y").mapInArrow(kernel, "n bigint, r array<double>")
        slots = max(1, math.isqrt(data.rdd.getNumPartitions()))
        few = part.repartition(slots).mapInPandas(joined, "n bigint, r array<double>").toPandas()  # slots rows
        last = next(joined([few]))
        return cls(np.reshape(last["r"][0], (width, width)), int(last["n"][0]))

    def gradient(self, params, loss):
        """Summed loss, row count and summed gradient, as :func:`_batch_gradient` gives them."""
        if not self.n:
            return 0.0, 0, None
        W, b = params
        X, one, Y = self.r[:, :len(W)], self.r[:, len(W)], self.r[:, len(W) + 1:]
        out = X @ W + np.outer(one, b)
        total, g = 0.0, np.zeros_like(out)
        for start, stop, name in loss:
            part, g[:, start:stop] = LOSSES[name](out[:, start:stop], Y[:, start:stop])
            total += part
        return total, self.n, flatten([X.T @ g, one @ g])


def _batch_gradient(data: DataFrame, params, acts, loss, need_grad: bool = True):
    """One job: summed loss, row count and summed gradient over ``data``."""
    size = sum(p.size for p in params) if need_grad else 0
    table = {a: ACTIVATIONS[a] for a in acts if a not in HEADS}  # shipped with the closure (user activations included)
    names = {loss} if isinstance(loss, str) else {name for *_, name in loss}
    losses = {name: LOSSES[name] for name in names if name in LOSSES}

    def kernel(it):
        total, n, gsum = 0.0, 0, np.zeros(size)
        for batch in it:
            if not batch.num_rows:
                continue
            lval, grads = loss_and_grad(params, acts, *matrices(batch), loss, need_grad, table, losses)
            total += lval
            n += batch.num_rows
            if need_grad:
                gsum += flatten(grads)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64()), pa.array([n], pa.int64()),
                                          pa.array([gsum], pa.list_(pa.float64()))], names=["loss", "n", "g"])

    part = data.select("x", "y").mapInArrow(kernel, _GRAD_SCHEMA)
    arr, sc = sum_partials(part, data.rdd.getNumPartitions(), {"g": size}, ["loss", "n"])
    n = int(sc["n"])
    return sc["loss"], n, (arr["g"] if need_grad and n else None)


FULL_BATCH = ("bfgs", "lbfgs")


@dataclass(frozen=True)
class Training:
    """How a network is trained; a plain dict in configs."""

    optimizer: str = "adam"
    eta: float = 1e-2
    beta: tuple = (0.9, 0.999)
    rho: float = 0.9
    eps: float = 1e-8
    decay: float = 0.0
    epochs: int = 4
    batches: int = 1
    seed: int = 0
    schedule: str | None = None
    schedule_params: dict = field(default_factory=dict)
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    loss: str | None = None  # for numeric targets mse, for categorical ones logitcrossentropy
    metrics: tuple = ()
    patience: int | None = None  # epochs without a better score before stopping
    plateau: int | None = None  # epochs in which the score moves by less than min_delta before stopping
    min_delta: float = 1e-6
    memory: int = 10  # curvature pairs of lbfgs
    g_tol: float = 1e-8  # bfgs and lbfgs end at a gradient this small

    @property
    def full_batch(self) -> bool:
        """BFGS and L-BFGS see all training rows at once: an epoch is one iteration."""
        return self.optimizer in FULL_BATCH

    def __post_init__(self):
        if self.full_batch and (self.batches != 1 or self.schedule is not None):
            raise ValueError(f"{self.optimizer} trains on the full batch: it takes neither batches nor a schedule")
        if self.full_batch and self.lambda_l1:
            raise ValueError(f"{self.optimizer} needs a smooth objective: lambda_l1 is for the other optimizers")
        if self.memory < 1:
            raise ValueError("memory must be >= 1")
        object.__setattr__(self, "beta", tuple(self.beta))
        object.__setattr__(self, "metrics", tuple(self.metrics))
        if self.loss is not None and self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss!r}; valid: {', '.join(LOSSES)}")
        unknown = set(self.metrics) - set(metric_names())
        if unknown:
            raise ValueError(f"unknown metrics {sorted(unknown)}; valid: {', '.join(metric_names())}")
        if self.schedule is not None and self.schedule not in (*SCHEDULES, *_USER_SCHEDULES):
            raise ValueError(f"unknown schedule {self.schedule!r}; valid: {', '.join((*SCHEDULES, *_USER_SCHEDULES))}")
        if not self.full_batch and self.optimizer not in _USER_OPTIMIZERS:
            Optimizer(self.optimizer)

    def rule(self):
        """A fresh first-order optimizer."""
        if self.optimizer in _USER_OPTIMIZERS:
            return _USER_OPTIMIZERS[self.optimizer](self)
        return Optimizer(self.optimizer, self.eta, self.rho, self.beta, self.eps, self.decay)

    @classmethod
    def from_dict(cls, d) -> "Training":
        if isinstance(d, cls):
            return d
        extra = set(d) - {f.name for f in dataclasses.fields(cls)}
        if extra:
            raise ValueError(f"unknown training fields: {sorted(extra)}")
        return cls(**d)

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(self).items()}


def _onehot_columns(column: str, lvls: Sequence) -> list:
    """A 0/1 column per level; a level unseen in training raises, NULL gives NULL."""
    c = qcol(column)
    unseen = F.raise_error(F.concat(F.lit(f"unseen level in {column}: "), c.cast("string"))).cast("double")
    return [F.when(c.isNull(), F.lit(None).cast("double")).when(c == F.lit(lv), F.lit(1.0))
            .when(c.isin(list(lvls)), F.lit(0.0)).otherwise(unseen) for lv in lvls]


def encoded_columns(columns: Sequence[str], levels: dict, transforms: dict | None = None) -> list:
    """Numeric columns through their registered transform, categorical ones one-hot, in config order."""
    out, transforms = [], transforms or {}
    for c in columns:
        if c in levels:
            out += _onehot_columns(c, levels[c])
        else:
            out.append(TRANSFORMS[transforms.get(c, "identity")](qcol(c).cast("double")))
    return out


def assemble(df: DataFrame, x: Sequence, y: Sequence, extra: Sequence = ()) -> DataFrame:
    """Rows ``(x array, y array)`` of the rows without NULL or NaN in any element."""
    cols = [c.alias(f"_x{i}") for i, c in enumerate(x)] + [c.alias(f"_y{i}") for i, c in enumerate(y)]
    flat = df.select(*cols, *extra).dropna(subset=[f"_x{i}" for i in range(len(x))] + [f"_y{i}" for i in range(len(y))])
    rest = [c for c in flat.columns if not c.startswith(("_x", "_y"))]
    return flat.select(F.array(*[F.col(f"_x{i}") for i in range(len(x))]).alias("x"),
                       F.array(*[F.col(f"_y{i}") for i in range(len(y))]).alias("y"), *rest)


@register_card("dense_net", "Neural network")
@dataclass(frozen=True)
class DenseNetCard(Card):
    """Dense network from ``inputs`` to ``targets`` (numeric -> regression, categorical -> classifier).

    With a ``funnel`` the columns are those of its rows, and its helper tables are bound by :meth:`with_helpers`.
    """

    inputs: tuple = ()
    targets: tuple = ()
    order_by: tuple = ()
    layers: tuple = ({"features": 16, "sigma": "relu"}, {"sigma": "identity"})
    training: Training = field(default_factory=Training)
    partition: str | None = None
    suffix: str = "hat"
    transforms: tuple = ()  # (input column, transform name) pairs
    funnel: Funnel | None = None
    helpers: dict = field(default_factory=dict, compare=False, repr=False)  # bound tables, not part of the config
    streamable = True

    def __post_init__(self):
        if self.funnel is not None:
            object.__setattr__(self, "funnel", funnel_from_dict(self.funnel))
            for f in ("inputs", "targets", "order_by"):
                if tuple(getattr(self, f)) not in ((), tuple(getattr(self.funnel, f))):
                    raise ValueError(f"the funnel names the {f}")
                object.__setattr__(self, f, tuple(getattr(self.funnel, f)))
        for f in ("inputs", "targets", "order_by"):
            v = getattr(self, f)
            object.__setattr__(self, f, (v,) if isinstance(v, str) else tuple(v))
        object.__setattr__(self, "layers", tuple(dict(layer) for layer in self.layers))
        object.__setattr__(self, "transforms", tuple(tuple(t) for t in self.transforms))
        object.__setattr__(self, "training", Training.from_dict(self.training))
        if not self.inputs or not self.targets or not self.order_by:
            raise ValueError("network needs order_by, inputs and targets")
        for col, name in self.transforms:
            if col not in self.inputs:
                raise ValueError(f"transform on {col!r}: only numeric inputs take transforms, not one-hot targets")
            if name not in TRANSFORMS:
                raise ValueError(f"unknown transform {name!r}; valid: {', '.join(TRANSFORMS)}")
        for i, layer in enumerate(self.layers):
            sigma = layer.get("sigma", "identity")
            if sigma not in ACTIVATIONS and sigma not in HEADS:
                raise ValueError(f"unknown activation {sigma!r}")
            if sigma in HEADS and i + 1 < len(self.layers):
                raise ValueError(f"{sigma!r} is for the last layer only")
        if self.layers[-1].get("sigma") == "logsumexp" and "features" not in self.layers[-1]:
            raise ValueError("a logsumexp layer names its features: they become one output")

    def to_dict(self):
        out = super().to_dict() | {"transforms": [list(t) for t in self.transforms]}
        del out["helpers"]
        return out

    def with_helpers(self, helpers: dict) -> "DenseNetCard":
        """The card with its funnel's helper tables, whose names must be the expected ones."""
        if self.funnel is None:
            raise ValueError("the card has no funnel")
        return dataclasses.replace(self, helpers=self.funnel.bind(helpers))

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows that the network sees: the funnel's, or the table itself."""
        if self.funnel is None:
            return df
        if set(self.helpers) != set(self.funnel.helper_keys()):
            raise ValueError(f"bind the helper tables {sorted(self.funnel.helper_keys())} by with_helpers first")
        return self.funnel.rows(df, self.helpers)

    def outputs(self):
        return [join_names(t, self.suffix) for t in self.targets]

    def source_variables(self):
        inputs = list(self.inputs) if self.funnel is None else self.funnel.reads()
        return SourceVariables(order_by=list(self.order_by), inputs=inputs, targets=list(self.targets),
                               partition=[self.partition] if self.partition else [])

    def output_variables(self):
        return OutputVariables(self.outputs())

    def slices(self, levels: dict) -> list[tuple[int, int, str]]:
        """Each target's outputs and its loss."""
        out, at = [], 0
        for t in self.targets:
            width = len(levels[t]) if t in levels else 1
            out.append((at, at + width, self.training.loss or ("logitcrossentropy" if t in levels else "mse")))
            at += width
        return out

    def fit(self, df: DataFrame, id_var: str | None = None, warm: CardState | None = None) -> CardState:
        tr, df = self.training, self.rows(df)
        levels = {c: level_list(df, c, self.partition) for c in dict.fromkeys(self.inputs + self.targets)
                  if not is_numerical(df.schema[c].dataType)}
        x = encoded_columns(self.inputs, levels, dict(self.transforms))
        y = encoded_columns(self.targets, levels)
        loss = self.slices(levels)
        acts = [layer.get("sigma", "identity") for layer in self.layers]
        if acts[-1] == "logsumexp" and len(y) != 1:
            raise ValueError(f"logsumexp has one output, the targets take {len(y)}")
        last = int(self.layers[-1]["features"]) if acts[-1] == "logsumexp" else len(y)
        sizes = [len(x)] + [int(layer["features"]) for layer in self.layers[:-1]] + [last]
        start_epoch, history, best = 0, [], (math.inf, None, 0)
        if warm is not None:  # N7: resume from saved weights; they stay the best until a better epoch comes
            params = [np.asarray(p, dtype=float) for p in warm.content["params"]]
            start_epoch, history = warm.content.get("epoch", 0), [tuple(h) for h in warm.content.get("history", [])]
            best = (warm.content.get("best", math.inf), copy.deepcopy(params), start_epoch)
        else:
            params = init_params(sizes, tr.seed)
        key = [qcol(c) for c in (id_var and [id_var] or self.order_by)]
        batch = F.pmod(F.xxhash64(*key, F.lit(tr.seed)), F.lit(tr.batches)).alias("_nb")
        train = assemble(split_rows(df, self.partition, 1), x, y, [batch])
        valid = assemble(split_rows(df, self.partition, 2), x, y)
        width = len(x) + 1 + len(y)
        fold = tr.full_batch and width <= FOLD_WIDTH and folds(acts, loss)
        if not fold or tr.metrics:  # read again in every epoch
            train, valid = train.persist(StorageLevel.MEMORY_AND_DISK), valid.persist(StorageLevel.MEMORY_AND_DISK)
        few = Folded.of(valid, width) if fold else None
        opt = None if tr.full_batch else tr.rule()
        descent = self._descent(Folded.of(train, width) if fold else train, params, acts, loss) if tr.full_batch else None
        bad_epochs = still = it = 0
        last_score = math.inf
        try:
            for epoch in range(start_epoch + 1, start_epoch + tr.epochs + 1):
                batch_means = []
                if descent is not None:
                    step = next(descent, None)
                    if step is None:
                        break
                    params = unflatten(step.weights, params)
                    batch_means.append(step.value)
                for b in range(0 if descent is not None else tr.batches):
                    part = train if tr.batches == 1 else train.where(F.col("_nb") == b)
                    lval, n, g = _batch_gradient(part, params, acts, loss)
                    if not n:
                        continue
                    if not math.isfinite(lval) or not np.isfinite(g).all():
                        raise ArithmeticError(f"training diverged in epoch {epoch}: loss {lval}")
                    w = flatten(params)
                    batch_means.append(lval / n + tr.lambda_l2 * float(w @ w) + tr.lambda_l1 * float(np.abs(w).sum()))
                    grad = g / n + tr.lambda_l2 * 2 * w + tr.lambda_l1 * np.sign(w)
                    it += 1
                    eta = schedule_value(tr.schedule, it, tr.schedule_params) if tr.schedule else None
                    params = unflatten(opt.step(w, grad, eta), params)
                if not batch_means:
                    raise ValueError("no training row has all inputs and targets")
                vl, vn, _ = few.gradient(params, loss) if fold else _batch_gradient(valid, params, acts, loss, need_grad=False)
                train_loss = float(np.mean(batch_means))
                val_loss = vl / vn if vn else math.nan
                history += [(epoch, "training", "loss", train_loss), (epoch, "validation", "loss", val_loss)]
                if tr.metrics:
                    for split, data in (("training", train), ("validation", valid)):
                        got = self._metrics(data, params, acts, loss)
                        history += [(epoch, split, m, v) for m, v in got.items()]
                score = val_loss if vn else train_loss
                if not math.isfinite(score):
                    raise ArithmeticError(f"training diverged in epoch {epoch}: score {score}")
                still = still + 1 if abs(score - last_score) < tr.min_delta else 0
                last_score = score
                if score < best[0]:
                    best = (score, copy.deepcopy(params), epoch)
                    bad_epochs = 0
                else:
                    bad_epochs += 1
                if tr.patience is not None and bad_epochs > tr.patience or tr.plateau is not None and still >= tr.plateau:
                    break
        finally:
            train.unpersist()
            valid.unpersist()
        return CardState(content={"params": [p.tolist() for p in best[1]], "acts": acts, "best": best[0],
                                  "levels": {k: list(v) for k, v in levels.items()}, "epoch": best[2],
                                  "successful": True, "history": history})

    def _descent(self, train: DataFrame | Folded, params, acts, loss):
        """The iterations of BFGS or L-BFGS; every value and gradient is one job over the cached training rows, or their fold."""
        tr = self.training

        def objective(w):
            at = unflatten(w, params)
            lval, n, g = train.gradient(at, loss) if isinstance(train, Folded) else _batch_gradient(train, at, acts, loss)
            if not n:
                raise ValueError("no training row has all inputs and targets")
            return lval / n + tr.lambda_l2 * float(w @ w), g / n + 2 * tr.lambda_l2 * w

        return descend(objective, flatten(params), tr.epochs, tr.memory if tr.optimizer == "lbfgs" else None, tr.g_tol)

    def _metrics(self, data: DataFrame, params, acts, slices) -> dict[str, float]:
        """The chosen metrics over assembled rows, each a mean over targets, in one aggregation."""
        out = _network(data, [F.col("x")[i] for i in range(params[0].shape[0])], params, acts, ["y"])
        cols = []
        for k, (start, stop, _) in enumerate(slices):
            pred = [F.col(f"_nn{len(acts) - 1}_{j}") for j in range(start, stop)]
            target = [F.col("y")[j] for j in range(start, stop)]
            cols += [metric_column(m, pred, target).alias(f"{m}_{k}") for m in self.training.metrics]
        r = out.agg(*cols).first()
        return {m: float(np.mean([math.nan if r[f"{m}_{k}"] is None else r[f"{m}_{k}"] for k in range(len(slices))]))
                for m in self.training.metrics}

    def validate(self, df: DataFrame, state: CardState, split: int = 2) -> dict[str, float]:
        """Loss and metrics of a fitted network on one split (N8); an unseen level raises."""
        levels = state.content["levels"]
        data = assemble(split_rows(self.rows(df), self.partition, split), encoded_columns(self.inputs, levels, dict(self.transforms)),
                        encoded_columns(self.targets, levels))
        params = [np.asarray(p, dtype=float) for p in state.content["params"]]
        total, n, _ = _batch_gradient(data, params, state.content["acts"], self.slices(levels), need_grad=False)
        out = {"loss": total / n if n else math.nan}
        if self.training.metrics:
            out |= self._metrics(data, params, state.content["acts"], self.slices(levels))
        return out

    def transform(self, df, state, id_var=None):
        """Prediction as column expressions: one projection per dense layer (JVM-side, codegen)."""
        params = [np.asarray(p, dtype=float) for p in state.content["params"]]
        acts, levels = state.content["acts"], state.content["levels"]
        outs = self.outputs()
        cols = [c for c in df.columns if c not in outs]
        cur = _network(self.rows(df), encoded_columns(self.inputs, levels, dict(self.transforms)), params, acts, cols)
        h = [F.col(f"_nn{len(acts) - 1}_{j}") for j in range(self.slices(levels)[-1][1])]
        preds = []
        for t, name, (start, stop, _) in zip(self.targets, outs, self.slices(levels)):
            if t in levels:
                arr = F.array(*h[start:stop])
                label = F.element_at(F.array(*[F.lit(v) for v in levels[t]]),
                                     F.array_position(arr, F.array_max(arr)).cast("int"))
                preds.append(F.when(F.array_max(arr).isNotNull(), label).alias(name))
            else:
                preds.append(h[start].alias(name))
        return cur.select(*[qcol(c) for c in cols], *preds)

    def report(self, state):
        hist = state.content.get("history", [])
        if not hist:
            return {}
        last = max(h[0] for h in hist)
        return {f"{split}_{metric}": value for e, split, metric, value in hist if e == last}


def _network(df: DataFrame, x: list, params, acts, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the last layer's outputs ``_nn<layer>_<unit>``: one projection per layer."""
    cur, h = df, x
    for li, act in enumerate(acts):
        W, b = params[2 * li], params[2 * li + 1]
        zs = []
        for j in range(W.shape[1]):
            z = F.lit(float(b[j]))
            for i, v in enumerate(h):
                z = z + v * F.lit(float(W[i, j]))
            zs.append(z)
        if act in HEADS:
            cur = cur.select(*[qcol(c) for c in keep], *[z.alias(f"_z{j}") for j, z in enumerate(zs)])
            units = head_exprs(act, [F.col(f"_z{j}") for j in range(len(zs))])
        else:
            units = [activation_expr(act, z) for z in zs]
        cur = cur.select(*[qcol(c) for c in keep], *[u.alias(f"_nn{li}_{j}") for j, u in enumerate(units)])
        h = [F.col(f"_nn{li}_{j}") for j in range(len(units))]
    return cur


def history_frame(spark, state: CardState) -> DataFrame:
    """Per-epoch metric history as a small DataFrame."""
    rows = [tuple(h) for h in state.content.get("history", [])]
    return spark.createDataFrame(rows, "epoch int, split string, metric string, value double")

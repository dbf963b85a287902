"""Quasi-Newton descent on known functions, and networks trained with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.operators import nn
from cardinal.operators.optim import ARMIJO, CURVATURE, MAX_BFGS, descend, wolfe_step
from tests.conftest import table


def rosenbrock(w):
    x, y = w[:-1], w[1:]
    g = np.zeros_like(w)
    g[:-1] += -400 * x * (y - x * x) - 2 * (1 - x)
    g[1:] += 200 * (y - x * x)
    return float((100 * (y - x * x) ** 2 + (1 - x) ** 2).sum()), g


@pytest.mark.parametrize("memory", [None, 3, 10])
def test_valley_of_known_minimum(memory):
    steps = list(descend(rosenbrock, np.array([-1.2, 1.0, -0.5, 0.8]), 300, memory, 1e-9))
    assert steps[-1].converged
    assert np.allclose(steps[-1].weights, 1, atol=1e-7)
    values = [s.value for s in steps]
    assert all(b <= a + 1e-12 for a, b in zip(values, values[1:], strict=False))
    assert steps[-1].evaluations < 250


def test_quadratic_takes_few_jobs():
    rng = np.random.default_rng(1)
    A = rng.normal(size=(40, 12))
    y = rng.normal(size=40)
    best = np.linalg.lstsq(A, y, rcond=None)[0]
    calls = []

    def f(w):
        calls.append(1)
        r = A @ w - y
        return float(r @ r), 2 * A.T @ r

    last = list(descend(f, np.zeros(12), 100, 10, 1e-9))[-1]
    assert np.allclose(last.weights, best, atol=1e-7)
    assert len(calls) == last.evaluations < 80


def test_wolfe_conditions_hold():
    for scale in (1e-3, 1.0, 1e3):
        along = lambda t, s=scale: ((s * t - 1) ** 4 + 0.1 * np.sin(3 * s * t), 4 * s * (s * t - 1) ** 3 + 0.3 * s * np.cos(3 * s * t))
        f0, d0 = along(0.0)
        t = wolfe_step(along, f0, d0, 1.0)
        f, d = along(t)
        assert f <= f0 + ARMIJO * t * d0
        assert abs(d) <= -CURVATURE * d0


def test_steps_into_undefined_ground_turn_back():
    f = lambda w: (float("nan"), w) if w[0] <= 0 else (float(w[0] - np.log(w[0])), 1 - 1 / w)
    assert abs(list(descend(f, np.array([8.0]), 60, 5))[-1].weights[0] - 1) < 1e-6
    with pytest.raises(ArithmeticError):
        list(descend(f, np.array([-1.0]), 5))
    with pytest.raises(ValueError, match="lbfgs"):
        next(descend(lambda w: (0.5 * float(w @ w), w), np.ones(MAX_BFGS + 1), 3, None))


def test_full_batch_rules():
    for bad in ({"batches": 2}, {"schedule": "exp"}, {"lambda_l1": 0.1}, {"memory": 0}):
        with pytest.raises(ValueError):
            nn.Training(optimizer="lbfgs", **bad)
    assert nn.Training.from_dict(nn.Training(optimizer="bfgs").to_dict()).full_batch


def test_network_with_ridge_meets_the_closed_form(spark):
    li = table(spark, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 1e4).alias("y"), (F.col("l_quantity") / 50).alias("a"), "l_discount")
    card = nn.DenseNetCard(inputs=("a", "l_discount"), targets=("y",), order_by=("l_orderkey",), layers=({"sigma": "identity"},),
                           training=nn.Training(optimizer="lbfgs", epochs=40, lambda_l2=0.05, g_tol=1e-10, metrics=("mae",)))
    state = card.fit(li)
    rows = li.toPandas()
    X = np.column_stack([rows.a, rows.l_discount, np.ones(len(rows))])
    n = len(rows)
    want = np.linalg.solve(X.T @ X / n + 0.05 * np.eye(3), X.T @ rows.y.to_numpy() / n)
    got = np.concatenate([np.ravel(p) for p in state.content["params"]])
    assert np.allclose(got, want, atol=1e-7)
    losses = [v for _, split, m, v in state.content["history"] if (split, m) == ("training", "loss")]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:], strict=False))
    assert len(losses) < 40  # ends when the gradient is gone
    again = card.fit(li, warm=state)
    assert np.allclose(np.concatenate([np.ravel(p) for p in again.content["params"]]), want, atol=1e-7)


def test_linear_net_reads_its_rows_once(spark, monkeypatch):
    """A linear network under mse is trained from one pass; the fold has the loss and gradient of all rows."""
    rng = np.random.default_rng(2)
    data = [(int(k), float(a), float(b), float(3 * a - b + 2 + c), float(b - a + c)) for k, (a, b, c) in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(data, "id long, a double, b double, u double, v double").repartition(5)
    rows = nn.assemble(df, [F.col("a"), F.col("b")], [F.col("u"), F.col("v")])
    params, loss = [rng.normal(size=(2, 2)), rng.normal(size=2)], [(0, 1, "mse"), (1, 2, "mse")]
    want, got = nn._batch_gradient(rows, params, ["identity"], loss), nn.Folded.of(rows, 5).gradient(params, loss)
    assert got[1] == want[1] == 400 and np.allclose(got[0], want[0], rtol=1e-12) and np.allclose(got[2], want[2], rtol=1e-11)
    assert nn.Folded.of(rows.limit(0), 5).gradient(params, loss) == (0.0, 0, None)

    def passes(*_, **__):
        raise AssertionError("the rows are read again")

    monkeypatch.setattr(nn, "_batch_gradient", passes)
    X = np.array([(1, r[1], r[2]) for r in data])
    plane = np.linalg.lstsq(X, np.array([r[3:] for r in data]), rcond=None)[0]
    for optimizer in ("bfgs", "lbfgs"):
        card = nn.DenseNetCard(inputs=("a", "b"), targets=("u", "v"), order_by=("id",), layers=({"sigma": "identity"},),
                               training=nn.Training(optimizer=optimizer, epochs=60, g_tol=1e-11))
        W, b = card.fit(df).content["params"]
        assert np.allclose(np.vstack([b, W]), plane, atol=1e-9)

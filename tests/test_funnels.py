"""Funnels of two tables, registries of metrics, schedules and optimizers, the logsumexp head, the variational loss."""

import json
import math
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.functions import metrics as M
from cardinal.operators import funnels, nn
from cardinal.plans.card import card_from_dict
from cardinal.plans.flow import CardGraph, Node

LINEAR = ({"sigma": "identity"},)
EXACT = nn.Training(optimizer="lbfgs", epochs=80, g_tol=1e-11)


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(4)
    goods = [(k, float(rng.normal()), float(rng.normal())) for k in range(12)] + [(None, 9.0, 9.0)]
    sales = [(i, None if i == 50 else i % 14, float(rng.normal())) for i in range(120)]
    by = {k: (u, v) for k, u, v in goods}
    rows = [(i, k, w, 1.5 * by.get(k, (0, 0))[0] - 2 * by.get(k, (0, 0))[1] + 0.5 * w + 3) for i, k, w in sales]
    return (spark.createDataFrame(rows, "id long, good long, w double, y double"),
            spark.createDataFrame(goods, "k long, u double, v double"), by)


def lookup(**more):
    return funnels.LookupFunnel(**{"on": (("good", "k"),), "columns": ("u", "v"), "targets": ("y",), "order_by": ("id",), "own": "w"} | more)


def test_two_tables_train_and_predict(spark, shop):
    sales, goods, by = shop
    card = nn.DenseNetCard(funnel=lookup(), layers=LINEAR, training=EXACT).with_helpers({"lookup": goods})
    assert card.inputs == ("w", "lookup_u", "lookup_v")
    graph = CardGraph([Node(card)])
    assert set(graph.nodes[0].inputs("eval")) == {"id", "good", "w"}
    out = graph.train_evaljoin(sales, "id").collect()
    assert len(out) == 120
    for r in out:
        if r["good"] is None or r["good"] > 11:  # no partner: no input, no prediction
            assert r["y_hat"] is None
        else:
            assert abs(r["y_hat"] - r["y"]) < 1e-5
    assert card.validate(sales, graph.nodes[0].state, split=1)["loss"] < 1e-10


def test_config_keeps_the_funnel_not_its_tables(spark, shop):
    sales, goods, _ = shop
    card = nn.DenseNetCard(funnel=lookup(prefix="g_"), layers=LINEAR).with_helpers({"lookup": goods})
    again = card_from_dict(json.loads(json.dumps(card.to_dict())))
    assert again == card and again.funnel == card.funnel
    with pytest.raises(ValueError, match="with_helpers"):
        again.fit(sales)
    for wrong in ({}, {"lookup": goods, "more": goods}, {"other": goods}):
        with pytest.raises(ValueError, match="helper tables"):
            card.with_helpers(wrong)
    with pytest.raises(ValueError, match="more than one row"):
        card.with_helpers({"lookup": goods.union(goods.where("k = 3"))})
    with pytest.raises(ValueError, match="prefix"):
        lookup(prefix="", columns=("w",)).rows(sales, {"lookup": goods.withColumn("w", F.lit(1.0))})
    with pytest.raises(ValueError, match="unknown funnel"):
        nn.DenseNetCard(funnel={"type": "nowhere"})
    with pytest.raises(ValueError, match="names the targets"):
        nn.DenseNetCard(funnel=lookup(), targets=("w",))
    plain = nn.DenseNetCard(funnel={"type": "table", "inputs": ["w"], "targets": ["y"], "order_by": ["id"]}, layers=LINEAR)
    assert plain.rows(sales) is sales


def test_a_funnel_of_the_user(spark, shop):
    sales, _, _ = shop

    @funnels.register_funnel("past_mean")
    @dataclass(frozen=True)
    class PastMean(funnels.Funnel):
        inputs = ("mean_w",)
        targets = ("t",)
        order_by = ("id",)

        def helper_keys(self):
            return ("history",)

        def reads(self):
            return ["good"]

        def rows(self, df, helpers):
            return df.join(helpers["history"].groupBy("good").agg(F.avg("w").alias("mean_w")), "good", "left")

    try:
        card = card_from_dict({"type": "dense_net", "funnel": {"type": "past_mean"}, "layers": [{"sigma": "identity"}], "training": EXACT.to_dict()})
        card = card.with_helpers({"history": sales})
        data = sales.join(sales.groupBy("good").agg((2 * F.avg("w") + 1).alias("t")), "good", "left")
        state = card.fit(data)
        out = card.transform(data, state)
        assert out.columns == data.columns + ["t_hat"]
        assert out.where("abs(t - t_hat) > 1e-5").count() == 0 and out.where("t_hat IS NOT NULL").count() == 119
    finally:
        del funnels.FUNNELS["past_mean"]


def test_registered_metric_schedule_and_optimizer(spark, shop):
    sales, _, _ = shop
    M.register_metric("bias", lambda p, y: (sum(((a - b) for a, b in zip(p[1:], y[1:])), p[0] - y[0]), len(p)))
    nn.register_schedule("halving", lambda t, p: p["start"] / t)

    class Plain:
        def __init__(self, tr):
            self.eta = tr.eta

        def step(self, w, g, eta=None):
            return w - (self.eta if eta is None else eta) * g

    nn.register_optimizer("plain", Plain)
    try:
        fits = []
        for rule in ("plain", "descent"):
            tr = nn.Training(optimizer=rule, epochs=3, schedule="halving", schedule_params={"start": 0.2}, metrics=("bias", "mae"), seed=2)
            card = nn.DenseNetCard(inputs=("w",), targets=("y",), order_by=("id",), layers=LINEAR, training=tr)
            fits.append(card.fit(sales).content)
        assert np.allclose(fits[0]["params"][0], fits[1]["params"][0]) and np.allclose(fits[0]["params"][1], fits[1]["params"][1])
        seen = [h for h in fits[0]["history"] if h[2] == "bias" and h[1] == "training"]
        assert [h[0] for h in seen] == [1, 2, 3] and all(math.isfinite(h[3]) for h in seen)
        assert abs(nn.schedule_value("halving", 4, {"start": 0.2}) - 0.05) < 1e-15
        for taken in (lambda: M.register_metric("mae", None), lambda: nn.register_schedule("exp", None), lambda: nn.register_optimizer("adam", None)):
            with pytest.raises(ValueError, match="library"):
                taken()
        for bad in ({"metrics": ("no_such",)}, {"schedule": "no_such"}, {"optimizer": "no_such"}):
            with pytest.raises(ValueError, match="unknown"):
                nn.Training(**bad)
    finally:
        del M._USER_METRICS["bias"], nn._USER_SCHEDULES["halving"], nn._USER_OPTIMIZERS["plain"]


def test_logsumexp_gradient_and_fit(spark, shop):
    sales, _, _ = shop
    rng = np.random.default_rng(0)
    params = [rng.normal(size=(2, 4)), rng.normal(size=4), rng.normal(size=(4, 3)), rng.normal(size=3)]
    X, Y, acts = rng.normal(size=(7, 2)), rng.normal(size=(7, 1)), ["tanh", "logsumexp"]
    _, grads = nn.loss_and_grad(params, acts, X, Y, "mse")
    w, g = nn.flatten(params), nn.flatten(grads)
    for i in range(w.size):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        num = (nn.loss_and_grad(nn.unflatten(up, params), acts, X, Y, "mse", False)[0]
               - nn.loss_and_grad(nn.unflatten(down, params), acts, X, Y, "mse", False)[0]) / 2e-6
        assert abs(num - g[i]) < 1e-5 * max(1, abs(num))
    assert np.allclose(nn.HEADS["logsumexp"][0](np.array([[1e4, 1e4]])), 1e4 + math.log(2))
    card = nn.DenseNetCard(inputs=("w",), targets=("y",), order_by=("id",), layers=({"features": 3, "sigma": "logsumexp"},),
                           training=nn.Training(optimizer="lbfgs", epochs=5, metrics=("mae",)))
    state = card.fit(sales)
    assert np.asarray(state.content["params"][0]).shape == (1, 3)
    row = card.transform(sales, state).where("id = 0").first()
    z = row["w"] * np.asarray(state.content["params"][0])[0] + np.asarray(state.content["params"][1])
    assert abs(row["y_hat"] - math.log(np.exp(z).sum())) < 1e-9
    with pytest.raises(ValueError, match="features"):
        nn.DenseNetCard(inputs=("w",), targets=("y",), order_by=("id",), layers=({"sigma": "logsumexp"},))
    with pytest.raises(ValueError, match="one output"):
        nn.DenseNetCard(inputs=("w",), targets=("y", "id"), order_by=("id",), layers=({"features": 3, "sigma": "logsumexp"},)).fit(sales)


def test_vae_loss_against_numpy(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(40, 8))
    names = ["p1", "p2", "p3", "x1", "x2", "x3", "m", "v"]
    df = spark.createDataFrame([tuple(map(float, r)) + (i % 5,) for i, r in enumerate(a)], ", ".join(f"{n} double" for n in names) + ", b int")
    roles = (names[:3], names[3:6], ["m"], ["v"])

    def loss(r, beta, agg):
        sq, dv = (r[:, :3] - r[:, 3:6]) ** 2, (np.exp(r[:, 7]) + r[:, 6] ** 2 - 1 - r[:, 7]) / 2
        return agg(sq) + beta * agg(dv)

    assert abs(M.evaluate_vae_loss(df, *roles, beta=0.3).first()[0] - loss(a, 0.3, np.mean)) < 1e-12
    assert abs(M.evaluate_vae_loss(df, *roles, agg="sum").first()[0] - loss(a, 1.0, np.sum)) < 1e-10
    batches = np.mean([loss(a[k::5], 2.0, np.mean) for k in range(5)])
    assert abs(M.evaluate_vae_loss(df, *roles, beta=2.0, batch="b").first()[0] - batches) < 1e-12
    holed = df.union(df.limit(1).withColumn("v", F.lit(None).cast("double")))
    assert abs(M.evaluate_vae_loss(holed, *roles, beta=0.3).first()[0] - loss(a, 0.3, np.mean)) < 1e-12
    assert math.isnan(M.evaluate_vae_loss(df.where("false"), *roles).first()[0])
    assert M.evaluate_vae_loss(df.where("false"), *roles, agg="sum").first()[0] is None
    with pytest.raises(ValueError, match="as many"):
        M.vae_loss_column([F.lit(1)], [], [F.lit(1)], [F.lit(1)])

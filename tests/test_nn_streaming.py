import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.operators import nn
from cardinal.operators.rescale import RescaleCard
from cardinal.operators.split import PercentileMethod, SplitCard
from cardinal.plans.flow import CardGraph, Node
from cardinal.streaming.scoring import apply_frozen, read_stream, score_to_table
from tests.conftest import SF, table


@pytest.mark.parametrize("loss,acts", [("mse", ["tanh", "identity"]), ("logitcrossentropy", ["relu", "identity"])])
def test_gradient_matches_finite_differences(loss, acts):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(20, 3))
    Y = rng.normal(size=(20, 2)) if loss == "mse" else np.eye(2)[rng.integers(0, 2, 20)]
    params = nn.init_params([3, 4, 2], 1)
    _, grads = nn.loss_and_grad(params, acts, X, Y, loss)
    w = nn.flatten(params)
    g = nn.flatten(grads)
    for i in rng.choice(len(w), 8, replace=False):
        d = np.zeros_like(w)
        d[i] = 1e-6
        lp, _ = nn.loss_and_grad(nn.unflatten(w + d, params), acts, X, Y, loss, False)
        lm, _ = nn.loss_and_grad(nn.unflatten(w - d, params), acts, X, Y, loss, False)
        assert abs((lp - lm) / 2e-6 - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_distributed_gradient_equals_local(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 2))
    Y = X @ np.array([[1.5], [-2.0]]) + 0.3
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(X, Y)], "x array<double>, y array<double>")
    params = nn.init_params([2, 3, 1], 2)
    total, n, g = nn._batch_gradient(df.repartition(5), params, ["relu", "identity"], "mse")
    lt, lg = nn.loss_and_grad(params, ["relu", "identity"], X, Y, "mse")
    assert n == 200 and abs(total - lt) < 1e-9 * abs(lt) and np.allclose(g, nn.flatten(lg))


def test_training_reduces_loss_and_keeps_best(spark):
    li = table(spark, "lineitem").withColumn("rid", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    split = SplitCard(PercentileMethod(0.8), order_by=("rid",))
    net = nn.DenseNetCard(inputs=("l_discount", "l_tax"), targets=("l_quantity",), order_by=("rid",),
                          layers=({"features": 4, "sigma": "relu"}, {"sigma": "identity"}),
                          training=nn.Training(eta=0.05, epochs=6, batches=2, seed=1), partition="partition")
    node = Node(net)
    out = CardGraph([Node(split), node]).train_evaljoin(li, "rid")
    hist = [h for h in node.state.content["history"] if h[1] == "validation"]
    assert hist[-1][3] < hist[0][3]
    assert node.state.content["successful"]
    assert out.where(F.col("l_quantity_hat").isNull()).count() == 0
    assert set(node.report()) == {"training_loss", "validation_loss"}


def test_optimizers_and_schedules_step():
    for rule in nn.Optimizer.RULES:
        opt = nn.Optimizer(rule, 0.1)
        w = np.array([1.0, -2.0])
        for _ in range(50):
            w = opt.step(w, 2 * w)
        assert np.all(np.isfinite(w)) and np.linalg.norm(w) < np.linalg.norm([1.0, -2.0]), rule
    for s in nn.SCHEDULES:
        vals = [nn.schedule_value(s, t, {"start": 0.1, "period": 5}) for t in range(1, 20)]
        assert all(v > 0 for v in vals), s


def test_stream_scoring_matches_batch(spark):
    ev = table(spark, "events")
    node = Node(RescaleCard("minmax", inputs=("value",), group_by=("event_type",)))
    node.fit(ev, "event_id")
    batch = node.evaluate(ev, "event_id").select("event_id", "value_rescaled")
    stream = read_stream(spark, SF, ev.schema, glob="events.parquet")
    assert stream.isStreaming
    got = score_to_table(stream, [node], "t_stream_minmax", "event_id").select("event_id", "value_rescaled")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()
    with pytest.raises(ValueError):
        apply_frozen(stream, [Node(split := SplitCard(PercentileMethod(0.5), order_by=("ts",)))])
    del split


def test_activation_expressions_match_numpy(spark):
    xs = [-7.0, -2.5, -0.3, 0.0, 0.4, 1.5, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "z double")
    for name, (f, _) in nn.ACTIVATIONS.items():
        got = [r[0] for r in df.select(nn.activation_expr(name, F.col("z"))).collect()]
        assert np.allclose(got, f(np.array(xs)), atol=1e-12), name


def test_gradient_adds_any_number_of_partitions(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(120, 2))
    Y = X @ np.array([[0.5], [1.0]])
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(X, Y)], "x array<double>, y array<double>")
    params = nn.init_params([2, 3, 1], 4)
    a = nn._batch_gradient(df.repartition(3), params, ["tanh", "identity"], "mse")
    b = nn._batch_gradient(df.repartition(40), params, ["tanh", "identity"], "mse")
    assert a[1] == b[1] == 120 and abs(a[0] - b[0]) < 1e-9 and np.allclose(a[2], b[2])


def test_registered_activation_and_transform(spark):
    nn.register_activation("square", lambda x: x * x, lambda x: 2 * x, lambda z: z * z)
    nn.register_transform("scaled", lambda c: c * 10.0)
    li = table(spark, "lineitem").withColumn("rid", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    card = nn.DenseNetCard(inputs=("l_discount", "l_tax"), targets=("l_quantity",), order_by=("rid",),
                           layers=({"features": 3, "sigma": "square"}, {"sigma": "identity"}),
                           training=nn.Training(eta=0.01, epochs=1, seed=2), transforms=(("l_tax", "scaled"),))
    node = Node(card)
    out = CardGraph([node]).train_evaljoin(li, "rid").select("l_discount", "l_tax", "l_quantity_hat").limit(50).toPandas()
    params = [np.asarray(p) for p in node.state.content["params"]]
    X = np.column_stack([out.l_discount, out.l_tax * 10.0])
    exp = nn.forward(params, ["square", "identity"], X)[0][-1][:, 0]
    assert np.allclose(out.l_quantity_hat, exp)
    with pytest.raises(ValueError):
        nn.DenseNetCard(inputs=("a",), targets=("b",), order_by=("a",), transforms=(("b", "identity"),))


def _points(spark, n=200):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(i, float(x), "hot" if x > 0 else "cold", float(3 * x), 1 if i % 5 else 2)
                                  for i, x in enumerate(rng.normal(size=n))], "id int, v double, side string, t double, part int")


def _net(**more):
    own = {"inputs": ("v",), "targets": ("t",), "order_by": ("id",), "layers": ({"sigma": "identity"},), "partition": "part"}
    return nn.DenseNetCard(**(own | more))


def test_null_and_nan_rows_are_left_out(spark):
    df = _points(spark)
    holes = df.union(spark.createDataFrame([(900, None, "hot", 1.0, 1), (901, float("nan"), "hot", 1.0, 1), (902, 1.0, "hot", None, 2)], df.schema))
    card = _net(training={"epochs": 3, "eta": 0.1})
    a, b = card.fit(df, "id"), card.fit(holes, "id")
    assert a.content["params"] == b.content["params"] and a.content["history"] == b.content["history"]
    got = {r.id: r.t_hat for r in card.transform(holes, b).collect()}
    assert got[900] is None and got[902] is not None


def test_divergence_raises(spark):
    with pytest.raises(ArithmeticError):
        _net(training={"optimizer": "descent", "eta": 1e200, "epochs": 5}).fit(_points(spark), "id")


def test_partial_sums_keep_nan(spark):
    from cardinal.functions.partials import sum_partials

    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([3.0, None], None)], "a array<double>, s double").repartition(2)
    arr, sc = sum_partials(df, 2, {"a": 2}, ["s"])
    assert arr["a"][0] == 4.0 and np.isnan(arr["a"][1]) and np.isnan(sc["s"])


def test_categorical_inputs_and_targets_metrics_and_validate(spark):
    df = _points(spark)
    card = _net(inputs=("side", "v"), targets=("side", "t"), layers=({"features": 4, "sigma": "tanh"}, {"sigma": "identity"}),
                training={"epochs": 5, "eta": 0.1, "metrics": ["accuracy", "mse"], "seed": 3})
    state = card.fit(df, "id")
    report = card.report(state)
    assert set(report) == {f"{s}_{m}" for s in ("training", "validation") for m in ("loss", "accuracy", "mse")}
    out = card.transform(df, state).where("part = 2").toPandas()
    got = card.validate(df, state)
    acc = (out.side == out.side_hat).mean()
    assert got["accuracy"] == pytest.approx((acc + 1.0) / 2)  # a single output is always the largest
    unseen = df.union(spark.createDataFrame([(999, 0.1, "warm", 0.3, 2)], df.schema))
    with pytest.raises(Exception, match="unseen level"):
        card.validate(unseen, state)


def test_config_round_trip_and_saved_network(spark, tmp_path):
    import json

    from cardinal.plans.card import card_from_dict

    card = _net(training={"epochs": 2, "optimizer": "adamw", "decay": 0.1, "beta": [0.8, 0.99], "metrics": ["mae"]}, transforms=(("v", "identity"),))
    assert card_from_dict(json.loads(card.to_json())) == card
    df = _points(spark)
    node = Node(card).fit(df, "id")
    node.save(str(tmp_path / "n"))
    again = Node.load(spark, str(tmp_path / "n"))
    again.save(str(tmp_path / "n"))
    again = Node.load(spark, str(tmp_path / "n"))
    assert again.card == card and again.report() == node.report()
    assert again.evaluate(df).exceptAll(node.evaluate(df)).count() == 0
    with pytest.raises(ValueError):
        nn.Training.from_dict({"epoch": 3})


def test_resume_keeps_the_best_score(spark):
    df = _points(spark)
    first = _net(training={"epochs": 6, "eta": 0.1}).fit(df, "id")
    worse = _net(training={"epochs": 1, "eta": 50.0}).fit(df, "id", warm=first)
    assert worse.content["params"] == first.content["params"] and worse.content["best"] == first.content["best"]


@pytest.mark.parametrize("loss,acts", [("mae", ["tanh", "identity"]), ("huber_loss", ["tanh", "identity"]), ("mse", ["tanh", "softmax"]),
                                       ("logitbinarycrossentropy", ["relu", "identity"]), ("mse", ["tanh", "logsoftmax"]),
                                       ([(0, 1, "mse"), (1, 3, "logitcrossentropy")], ["tanh", "identity"])])
def test_every_loss_and_head_has_its_gradient(loss, acts):
    rng = np.random.default_rng(2)
    X, Y = rng.normal(size=(15, 3)), np.column_stack([rng.normal(size=15), np.eye(2)[rng.integers(0, 2, 15)]])
    params = nn.init_params([3, 4, 3], 1)
    w, g = nn.flatten(params), nn.flatten(nn.loss_and_grad(params, acts, X, Y, loss)[1])
    for i in range(len(w)):
        d = np.zeros_like(w)
        d[i] = 1e-6
        up, down = (nn.loss_and_grad(nn.unflatten(w + s * d, params), acts, X, Y, loss, False)[0] for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(g[i], abs=2e-4)

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.functions.distances import DISTANCES, Dissimilarity
from cardinal.operators import cluster, dimred, glm, interp
from cardinal.plans.flow import CardGraph, Node
from tests.conftest import SF, table


def test_pca_matches_numpy(spark):
    li = table(spark, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    X = np.asarray(li.collect(), dtype=float)
    card = dimred.DimensionalityReductionCard("pca", inputs=("l_quantity", "l_extendedprice", "l_discount"), n_components=2)
    out = np.asarray(CardGraph([card]).train_evaljoin(li).select("l_quantity", "l_extendedprice", "l_discount",
                                                                  "component_1", "component_2").collect(), dtype=float)
    Xc = X - X.mean(0)
    vals, vecs = np.linalg.eigh(np.cov(Xc.T, bias=True))
    V = vecs[:, ::-1][:, :2]
    for j in range(2):
        if V[np.argmax(np.abs(V[:, j])), j] < 0:
            V[:, j] *= -1
    # rows come back in the same scan order
    exp = (out[:, :3] - X.mean(0)) @ V
    assert np.allclose(out[:, 3:], exp, rtol=1e-6, atol=1e-6)


def test_ppca_fa_shapes(spark):
    li = table(spark, "lineitem")
    for m in ("ppca", "factoranalysis", "mds"):
        card = dimred.DimensionalityReductionCard(m, inputs=("l_quantity", "l_extendedprice", "l_tax"), n_components=2)
        out = CardGraph([card]).train_evaljoin(li).select("component_1", "component_2")
        r = out.agg(F.avg("component_1"), F.stddev_pop("component_1")).first()
        assert abs(r[0]) < 1e-6 * max(1.0, r[1])


def test_gamma_log_single_factor_is_group_means(spark):
    o = table(spark, "orders")
    card = glm.GLMCard(target="o_totalprice", formula=(1, "o_orderpriority"), distribution="gamma", link="log",
                       weights="o_custkey")
    out = CardGraph([card]).train_evaljoin(o, "o_orderkey")
    chk = out.groupBy("o_orderpriority").agg(
        (F.sum(F.col("o_custkey") * F.col("o_totalprice")) / F.sum("o_custkey")).alias("wm"),
        F.min("o_totalprice_hat").alias("lo"), F.max("o_totalprice_hat").alias("hi")).collect()
    for r in chk:
        assert abs(r.lo - r.wm) < 1e-6 * r.wm and abs(r.hi - r.wm) < 1e-6 * r.wm


def test_lm_categorical_matches_lstsq(spark):
    li = table(spark, "lineitem")
    card = glm.GLMCard(target="l_extendedprice", formula=(1, ("l_returnflag", "l_quantity"), "l_tax"))
    pdf = CardGraph([card]).train_evaljoin(li).select("l_returnflag", "l_quantity", "l_tax", "l_extendedprice",
                                                       "l_extendedprice_hat").toPandas()
    levels = sorted(pdf.l_returnflag.unique())
    cols = [np.ones(len(pdf))]
    dummies = [(pdf.l_returnflag == lv).astype(float).to_numpy() for lv in levels[1:]]
    cols += dummies + [pdf.l_quantity.to_numpy()] + [d * pdf.l_quantity.to_numpy() for d in dummies] + [pdf.l_tax.to_numpy()]
    X = np.column_stack(cols)
    beta = np.linalg.lstsq(X, pdf.l_extendedprice.to_numpy(), rcond=None)[0]
    assert np.allclose(X @ beta, pdf.l_extendedprice_hat, rtol=1e-7)


def test_poisson_binomial_converge(spark):
    li = table(spark, "lineitem")
    card = glm.GLMCard(target="l_quantity", formula=(1, "l_discount"), distribution="poisson")
    node_out = CardGraph([card]).train_evaljoin(li)
    r = node_out.agg(F.sum("l_quantity"), F.sum("l_quantity_hat")).first()
    assert abs(r[0] - r[1]) < 1e-6 * r[0]  # canonical link with intercept: fitted total = observed total


@pytest.mark.parametrize("name", DISTANCES)
def test_distance_expressions_match_numpy(spark, name):
    w = (2.0, 0.5, 1.5) if name.startswith("weighted") else ()
    dist = Dissimilarity(name, p=3.0, weights=w)
    c = np.array([1.0, -2.0, 0.5])
    df = spark.createDataFrame([(0.3, 1.2, -4.0), (5.0, 0.0, 2.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(dist.column([F.col("a"), F.col("b"), F.col("c")], c)).collect()]
    got_arr = [r[0] for r in df.select(dist.array_column(F.array("a", "b", "c"), c)).collect()]
    exp = dist.numpy(np.array([[0.3, 1.2, -4.0], [5.0, 0.0, 2.0]]), c)
    assert np.allclose(got, exp) and np.allclose(got_arr, exp)


def test_kmeans_is_a_lloyd_fixed_point(spark):
    cust = table(spark, "customer")
    res = cluster.kmeans_fit(cust, ["c_acctbal", "c_nationkey"], 4, seed=5)
    X = np.asarray(cust.select("c_acctbal", "c_nationkey").collect(), dtype=float)
    C = res["centres"]
    lab = np.argmin(((X[:, None, :] - C[None]) ** 2).sum(-1), axis=1)
    newC = np.array([X[lab == j].mean(0) for j in range(4)])
    assert np.allclose(newC, C, rtol=1e-4)


def test_cluster_card_labels_training_rows_only(spark):
    df = table(spark, "customer").withColumn("p", F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(1))
    card = cluster.ClusterCard(cluster.KMeansMethod(3, seed=1), inputs=("c_acctbal",), partition="p")
    out = CardGraph([card]).train_evaljoin(df, "c_custkey")
    assert out.where((F.col("p") == 2) & F.col("cluster").isNotNull()).count() == 0
    assert out.where((F.col("p") == 1) & F.col("cluster").isNull()).count() == 0


def test_interp_linear_quadratic_match_numpy(spark):
    xs = np.array([0.0, 1.0, 2.5, 4.0, 7.0, 8.0])
    ys = xs ** 2 - 3 * xs
    rows = [(int(i), float(x), float(y), 1) for i, (x, y) in enumerate(zip(xs, ys))]
    q = np.linspace(-1, 9, 41)
    rows += [(100 + i, float(x), None, 2) for i, x in enumerate(q)]
    df = spark.createDataFrame(rows, "id long, x double, y double, p int")
    lin = interp.InterpCard(input="x", targets=("y",), method="linear", partition="p",
                            extrapolation_left="constant", extrapolation_right="constant")
    out = CardGraph([lin]).train_evaljoin(df, "id").where("p = 2").orderBy("id").toPandas()
    assert np.allclose(out.y_hat, np.interp(q, xs, ys))
    quad = interp.InterpCard(input="x", targets=("y",), method="quadratic", partition="p",
                             extrapolation_left="extension", extrapolation_right="extension")
    out = CardGraph([quad]).train_evaljoin(df, "id").where("p = 2").orderBy("id").toPandas()
    assert np.allclose(out.y_hat, q ** 2 - 3 * q)  # exact for a quadratic
    none = interp.InterpCard(input="x", targets=("y",), method="linear", partition="p")
    with pytest.raises(Exception):
        CardGraph([none]).train_evaljoin(df, "id").collect()


def test_glm_unseen_level_predicts_null(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (2, "a", 2.0, 1), (3, "b", 5.0, 1), (4, "b", 7.0, 1), (5, "c", 1.0, 2)],
                               "id long, g string, y double, p int")
    card = glm.GLMCard(target="y", formula=(1, "g"), partition="p")
    out = {r.id: r.y_hat for r in CardGraph([card]).train_evaljoin(df, "id").collect()}
    assert abs(out[1] - 1.5) < 1e-9 and abs(out[3] - 6.0) < 1e-9 and out[5] is None


def _np_pchip_slopes(x, y):
    h = np.diff(x)
    d = np.diff(y) / h
    n = len(x)
    m = np.zeros(n)
    for k in range(1, n - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])

    def end(h0, h1, d0, d1):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(e) != np.sign(d0):
            return 0.0
        if np.sign(d0) != np.sign(d1) and abs(e) > 3 * abs(d0):
            return 3 * d0
        return e

    m[0] = end(h[0], h[1], d[0], d[1])
    m[-1] = end(h[-1], h[-2], d[-1], d[-2])
    return m


def _np_akima_slopes(x, y):
    s = np.diff(y) / np.diff(x)
    ext = np.concatenate([[3 * s[0] - 2 * s[1], 2 * s[0] - s[1]], s, [2 * s[-1] - s[-2], 3 * s[-1] - 2 * s[-2]]])
    t = np.zeros(len(x))
    for i in range(len(x)):
        mm2, mm1, m0, mp1 = ext[i], ext[i + 1], ext[i + 2], ext[i + 3]
        w1, w2 = abs(mp1 - m0), abs(mm1 - mm2)
        t[i] = (mm1 + m0) / 2 if w1 + w2 == 0 else (w1 * mm1 + w2 * m0) / (w1 + w2)
    return t


def _np_hermite(x, y, m, q):
    k = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t = (q - x[k]) / h
    return ((2 * t ** 3 - 3 * t ** 2 + 1) * y[k] + (t ** 3 - 2 * t ** 2 + t) * h * m[k]
            + (-2 * t ** 3 + 3 * t ** 2) * y[k + 1] + (t ** 3 - t ** 2) * h * m[k + 1])


@pytest.mark.parametrize("method", ["pchip", "akima"])
def test_hermite_methods_match_numpy(spark, method):
    xs = np.array([0.0, 1.0, 2.5, 4.0, 7.0, 8.0, 9.5])
    ys = np.array([0.0, 2.0, 1.0, 1.0, 5.0, 4.0, 6.0])
    q = np.linspace(0, 9.5, 39)
    rows = [(int(i), float(a), float(b), 1) for i, (a, b) in enumerate(zip(xs, ys))]
    rows += [(100 + i, float(a), None, 2) for i, a in enumerate(q)]
    df = spark.createDataFrame(rows, "id long, x double, y double, p int")
    card = interp.InterpCard(input="x", targets=("y",), method=method, partition="p")
    out = CardGraph([card]).train_evaljoin(df, "id").where("p = 2").orderBy("id").toPandas()
    m = _np_pchip_slopes(xs, ys) if method == "pchip" else _np_akima_slopes(xs, ys)
    assert np.allclose(out.y_hat, _np_hermite(xs, ys, m, q))


def _dense_deviance(X, Z_blocks, y, theta, q):
    from cardinal.operators.mixed import _lower

    L = _lower(np.asarray(theta), q)
    G = len(Z_blocks)
    n = len(y)
    Z = np.zeros((n, q * G))
    for gi, (rows, Zg) in enumerate(Z_blocks):
        Z[np.ix_(rows, range(gi * q, gi * q + q))] = Zg
    Lam = np.kron(np.eye(G), L)
    ZL = Z @ Lam
    A = np.block([[ZL.T @ ZL + np.eye(q * G), ZL.T @ X], [X.T @ ZL, X.T @ X]])
    rhs = np.concatenate([ZL.T @ y, X.T @ y])
    sol = np.linalg.solve(A, rhs)
    u, beta = sol[: q * G], sol[q * G:]
    r2 = np.sum((y - X @ beta - ZL @ u) ** 2) + np.sum(u ** 2)
    logdet = np.linalg.slogdet(ZL.T @ ZL + np.eye(q * G))[1]
    return logdet + n * (1 + np.log(2 * np.pi * r2 / n)), beta


def test_mixed_model_profiled_deviance_matches_dense(spark):
    from cardinal.operators import mixed

    rng = np.random.default_rng(4)
    G, m = 12, 15
    g = np.repeat(np.arange(G), m)
    x = rng.normal(size=G * m)
    b0, b1 = rng.normal(scale=2.0, size=G), rng.normal(scale=0.5, size=G)
    y = 1.0 + 0.7 * x + b0[g] + b1[g] * x + rng.normal(scale=0.3, size=G * m)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g long, x double, y double")
    X = np.column_stack([np.ones_like(x), x])
    blocks = [(np.flatnonzero(g == k), X[g == k]) for k in range(G)]
    _, xspec = glm.design(df, [1, "x"])
    groups, glob = mixed.group_statistics(df, glm.design_columns(xspec), glm.design_columns(xspec), F.col("y"),
                                          F.lit(1.0), "g")
    for theta in ([1.0, 0.0, 1.0], [3.0, 0.5, 0.8], [0.2, -0.1, 0.05]):
        dev, beta, _ = mixed.profiled_deviance(groups, glob, theta, 2, 2)
        ddev, dbeta = _dense_deviance(X, blocks, y, theta, 2)
        assert abs(dev - ddev) < 1e-7 * abs(ddev) and np.allclose(beta, dbeta)
    card = mixed.MixedModelCard(target="y", fixed=(1, "x"), random=(1, "x"), group="g")
    node_out = CardGraph([card]).train_evaljoin(df)
    res = node_out.select("y", "y_hat").toPandas()
    assert np.corrcoef(res.y, res.y_hat)[0, 1] > 0.95


def _np_natural_spline(x, y, q):
    n = len(x)
    h = np.diff(x)
    A = np.zeros((n, n))
    rhs = np.zeros(n)
    A[0, 0] = A[-1, -1] = 1.0
    for i in range(1, n - 1):
        A[i, i - 1], A[i, i], A[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    M = np.linalg.solve(A, rhs)
    k = np.clip(np.searchsorted(x, q, side="right") - 1, 0, n - 2)
    a, b, hk = x[k + 1] - q, q - x[k], h[k]
    return M[k] * a ** 3 / (6 * hk) + M[k + 1] * b ** 3 / (6 * hk) + (y[k] / hk - M[k] * hk / 6) * a \
        + (y[k + 1] / hk - M[k + 1] * hk / 6) * b


def test_cubic_spline_blocks_match_global_solve(spark, monkeypatch):
    monkeypatch.setattr(interp, "SPLINE_BLOCK", 16)
    monkeypatch.setattr(interp, "SPLINE_HALO", 12)
    rng = np.random.default_rng(7)
    xs = np.cumsum(rng.uniform(0.2, 2.0, size=70))
    ys = np.sin(xs) + rng.normal(scale=0.1, size=70)
    q = np.linspace(xs[0], xs[-1], 101)
    rows = [(int(i), float(a), float(b), 1) for i, (a, b) in enumerate(zip(xs, ys))]
    rows += [(1000 + i, float(a), None, 2) for i, a in enumerate(q)]
    df = spark.createDataFrame(rows, "id long, x double, y double, p int")
    card = interp.InterpCard(input="x", targets=("y",), method="cubicspline", partition="p")
    out = CardGraph([card]).train_evaljoin(df, "id").where("p = 2").orderBy("id").toPandas()
    assert np.allclose(out.y_hat, _np_natural_spline(xs, ys, q), atol=1e-6)


def test_quadratic_spline_matches_recurrence(spark):
    xs = np.array([0.0, 1.0, 2.5, 4.0, 7.0, 8.0, 9.5])
    ys = np.array([0.0, 2.0, 1.0, 1.0, 5.0, 4.0, 6.0])
    q = np.linspace(0, 9.5, 39)
    d = np.diff(ys) / np.diff(xs)
    z = np.zeros(len(xs))
    for i in range(len(xs) - 1):
        z[i + 1] = 2 * d[i] - z[i]
    k = np.clip(np.searchsorted(xs, q, side="right") - 1, 0, len(xs) - 2)
    t = q - xs[k]
    exp = ys[k] + z[k] * t + (d[k] - z[k]) * t * t / (xs[k + 1] - xs[k])
    rows = [(int(i), float(a), float(b), 1) for i, (a, b) in enumerate(zip(xs, ys))]
    rows += [(100 + i, float(a), None, 2) for i, a in enumerate(q)]
    df = spark.createDataFrame(rows, "id long, x double, y double, p int")
    card = interp.InterpCard(input="x", targets=("y",), method="quadraticspline", partition="p")
    out = CardGraph([card]).train_evaljoin(df, "id").where("p = 2").orderBy("id").toPandas()
    assert np.allclose(out.y_hat, exp)


def test_glmm_poisson_laplace_matches_dense(spark):
    from cardinal.operators import mixed

    rng = np.random.default_rng(11)
    G, m = 10, 20
    g = np.repeat(np.arange(G), m)
    x = rng.normal(size=G * m)
    y = rng.poisson(np.exp(0.5 + 0.4 * x + rng.normal(scale=0.6, size=G)[g])).astype(float)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g long, x double, y double")
    X = np.column_stack([np.ones_like(x), x])
    Z = np.zeros((G * m, G))
    Z[np.arange(G * m), g] = 1.0
    theta = 0.7
    # dense penalised IRLS with fixed effects inside
    beta, u = np.zeros(2), np.zeros(G)
    for _ in range(100):
        eta = X @ beta + theta * (Z @ u)
        mu = np.exp(eta)
        W, zeta = mu, eta + (y - mu) / mu
        ZL = theta * Z
        A = np.block([[ZL.T @ (W[:, None] * ZL) + np.eye(G), ZL.T @ (W[:, None] * X)],
                      [X.T @ (W[:, None] * ZL), X.T @ (W[:, None] * X)]])
        sol = np.linalg.solve(A, np.concatenate([ZL.T @ (W * zeta), X.T @ (W * zeta)]))
        if np.allclose(sol, np.concatenate([u, beta]), atol=1e-12, rtol=1e-12):
            break
        u, beta = sol[:G], sol[G:]
    mu = np.exp(X @ beta + theta * (Z @ u))
    devres = 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))
    logdet = np.linalg.slogdet(theta ** 2 * Z.T @ (mu[:, None] * Z) + np.eye(G))[1]
    dense = devres.sum() + u @ u + logdet
    _, xspec = glm.design(df, [1, "x"])
    _, zspec = glm.design(df, [1])
    dev, b, table = mixed.pirls(df, glm.design_columns(xspec), glm.design_columns(zspec), F.col("y"), F.lit(1.0),
                                "g", [theta], "poisson", "log", [0.0, 0.0])
    assert abs(dev - dense) < 1e-5 * abs(dense) and np.allclose(b, beta, atol=1e-5)
    card = mixed.MixedModelCard(target="y", fixed=(1, "x"), random=(1,), group="g", distribution="poisson")
    node = Node(card)
    out = CardGraph([node]).train_evaljoin(df).select("y", "y_hat").toPandas()
    assert (out.y_hat > 0).all()
    th = node.state.content["theta"][0]
    best = node.state.content["deviance"]
    for other in (th * 0.7, th * 1.4):  # the fitted theta minimises the Laplace deviance
        d_other, _, _ = mixed.pirls(df, glm.design_columns(xspec), glm.design_columns(zspec), F.col("y"), F.lit(1.0),
                                    "g", [other], "poisson", "log", [0.0, 0.0])
        assert best <= d_other + 1e-6 * abs(d_other)


def test_interp_hot_input_value_is_split(spark):
    # a third of the rows share one input value; brackets must still be right with many partitions
    rows = [(i, 5.0, None, 2) for i in range(300)]
    rows += [(1000 + i, float(i), float(2 * i), 1) for i in range(0, 11)]
    rows += [(2000 + i, i / 10.0, None, 2) for i in range(0, 100)]
    df = spark.createDataFrame(rows, "id long, x double, y double, p int")
    card = interp.InterpCard(input="x", targets=("y",), method="linear", partition="p")
    out = interp.interpolate(df, "x", ["y"], ["y_hat"], card.fit(df).tables["knots"])
    got = out.where("p = 2").select("x", "y_hat").toPandas()
    assert np.allclose(got.y_hat, 2 * got.x)


def test_lloyd_step_adds_all_partitions(spark):
    emb = table(spark, "embeddings")
    feats = emb.select(F.col("embedding").cast("array<double>").alias("x"), F.lit(1.0).alias("w")).repartition(4)
    C = np.random.default_rng(0).normal(size=(5, 64))
    dist = Dissimilarity("cityblock")
    a = cluster.lloyd_step(feats, C, dist, 4)
    b = cluster.lloyd_step(feats.repartition(17), C, dist, 17)
    X = np.asarray([r[0] for r in emb.select("embedding").collect()], dtype=float)
    D = np.column_stack([dist.numpy(X, c) for c in C])
    lab = D.argmin(1)
    exp = np.array([X[lab == j].sum(0) for j in range(5)])
    for got in (a, b):
        assert np.allclose(got[0], exp) and np.allclose(got[1], np.bincount(lab, minlength=5))


def test_variance_ratio_has_no_upper_bound(spark):
    from cardinal.operators.mixed import MixedModelCard

    rng = np.random.default_rng(4)
    shift = rng.normal(0, 50, 40)
    rows = [(g, float(shift[g] + rng.normal())) for g in range(40) for _ in range(12)]
    df = spark.createDataFrame(rows, "g int, y double")
    state = MixedModelCard(target="y", fixed=(1,), random=(1,), group="g").fit(df)
    assert 30 < state.content["theta"][0] < 80 and 0.8 < state.content["sigma2"] < 1.2


def test_logit_is_stable_far_out(spark):
    from cardinal.operators.glm import link_fns

    _, inverse, slope = link_fns("logit")
    rows = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "e double").select(inverse(F.col("e")).alias("m"), slope(F.col("e")).alias("d")).collect()
    assert [round(r.m, 12) for r in rows] == [0.0, 0.5, 1.0] and all(r.d > 0 for r in rows) and rows[1].d == 0.25


def test_glm_reports_convergence(spark):
    df = spark.createDataFrame([(float(x), int(x > 0)) for x in range(-10, 11)], "x double, y int")
    card = glm.GLMCard(target="y", formula=(1, "x"), distribution="binomial", iterations=4)
    assert card.fit(df).content["converged"] is False  # separable: no finite optimum
    assert glm.GLMCard(target="x", formula=(1, "y")).fit(df).content["converged"] is True


def test_arrays_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "v array<double>")
    with pytest.raises(ValueError, match="2 to 3"):
        cluster.feature_columns(df, ["v"])


def test_seeds_come_from_all_rows(spark):
    df = spark.createDataFrame([(float(c * 100 + i % 3),) for c in range(3) for i in range(400 if c < 2 else 2)], "x double").repartition(5)
    centres = np.sort(cluster.kmeans_fit(df, ["x"], 3)["centres"].ravel())
    assert np.allclose(centres, [1.0, 101.0, 200.5], atol=0.6)


def test_summary_lists_every_level(spark):
    from cardinal.operators.summary import summarize

    got = summarize(spark.range(20_000).selectExpr("concat('k', id) as k"))[0]
    assert got.values.count() == 20_000


def test_pca_embeddings_reads_every_component(spark):
    import __spark_entry__ as e

    rows = table(spark, "embeddings").select("vec_id", "embedding").collect()
    X = np.array([r.embedding for r in rows], dtype=float)
    assert X.shape[1] == 64
    vals, vecs = np.linalg.eigh(np.cov(X.T, bias=True))
    V = dimred._sign_fix(vecs[:, ::-1][:, :3])
    exp = dict(zip([r.vec_id for r in rows], (X - X.mean(0)) @ V))
    got = e.pca_embeddings(spark, SF).collect()
    assert sorted(exp) == sorted(r.vec_id for r in got)
    assert np.allclose([r[1:] for r in got], [exp[r.vec_id] for r in got], rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("query,target,terms,link", [("glm_binomial", "quality", (1, "n_chars", "lang"), None),
                                                     ("glm_probit", "toxic", (1, "n_chars"), "probit")])
def test_glm_queries_predict_every_document(spark, query, target, terms, link):
    import __spark_entry__ as e

    docs, labels = table(spark, "documents").select("doc_id", "n_chars", "lang"), table(spark, "labels")
    got = {r[0]: r[1] for r in getattr(e, query)(spark, SF).collect()}
    assert sorted(got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(v is not None and 0 <= v <= 1 for v in got.values())
    # Fitted on the labelled rows alone.
    card = glm.GLMCard(target=target, formula=terms, distribution="binomial", link=link)
    fitted = CardGraph([card]).train_evaljoin(labels.join(docs, "doc_id"))
    for r in fitted.select("doc_id", f"{target}_hat").collect():
        assert abs(got[r[0]] - r[1]) < 1e-9


def test_penalised_iteration_passes_the_rows_once(spark):
    from cardinal.operators import mixed

    seen = spark.sparkContext.accumulator(0)

    def counted(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf

    rng = np.random.default_rng(3)
    rows = [(int(k % 6), float(x), int(x + k % 6 > 2.5)) for k, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "g long, x double, y int").mapInPandas(counted, "g long, x double, y int")
    X, Z = [F.lit(1.0), F.col("x")], [F.lit(1.0)]
    _, _, modes = mixed.pirls(df, X, Z, F.col("y"), F.lit(1.0), "g", [1.0], "binomial", "logit", [0.0, 0.0], iterations=3)
    assert seen.value == 3 * len(rows)
    assert modes.count() == 6
    rows_ = mixed.model_rows(spark.createDataFrame(rows, "g long, x double, y int"), X, Z, F.col("y"), F.lit(1.0), "g")
    near, start, _ = mixed.pirls_rows(rows_, 2, 1, [1.0], "binomial", "logit", [0.0, 0.0])
    again, beta, _ = mixed.pirls_rows(rows_, 2, 1, [1.0], "binomial", "logit", start, modes)
    assert abs(near - again) < 1e-5 * abs(near) and np.allclose(beta, start, atol=1e-3)

"""DBSCAN on a cell graph and connected components, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardinal.functions.distances import Dissimilarity
from cardinal.operators import density
from cardinal.operators.cluster import ClusterCard, DBSCANMethod
from cardinal.operators.graph import components
from cardinal.plans.card import card_from_dict
from cardinal.plans.flow import Node

EUCLID = Dissimilarity("euclidean")


def plain_dbscan(ids, X, radius, min_neighbors, min_size, dist):
    n = len(X)
    near = [np.flatnonzero(dist.numpy(X, X[i]) <= radius) for i in range(n)]
    core = np.array([len(a) - 1 >= min_neighbors for a in near], bool)
    comp = {}
    for i in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if i in comp:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = ids[i]
                todo += [y for y in near[x] if core[y]]
    touches = {i: {comp[j] for j in near[i] if core[j]} if not core[i] else {comp[i]} for i in range(n)}
    size = {}
    for found in touches.values():
        for c in found:
            size[c] = size.get(c, 0) + 1
    label = {c: k for k, c in enumerate(sorted(c for c, s in size.items() if s >= min_size), 1)}
    return {ids[i]: min((label[c] for c in touches[i] if c in label), default=0) for i in range(n)}


def labels(spark, rows, radius, min_neighbors=1, min_size=1, dist=EUCLID):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "id bigint, x array<double>")
    found = density.dbscan_points(df, radius, min_neighbors, min_size, dist)
    return {r.id: r.label for r in df.join(found, "x").collect()}


METRICS = [EUCLID, Dissimilarity("chebyshev"), Dissimilarity("weighted_minkowski", p=4.0, weights=(2.0, 0.5))]


@pytest.mark.parametrize("dist", METRICS, ids=lambda m: m.type)
def test_two_dimensions(spark, dist, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 6)
    rng = random.Random(len(dist.type))
    rows = [(i * 7 + 3, (rng.gauss(c, 0.5), rng.gauss(-c, 0.5))) for i, c in enumerate([0, 0, 0, 4, 9] * 30)]
    rows += [(2000 + i, (rng.uniform(-5, 15), rng.uniform(-15, 5))) for i in range(40)]
    ids, X = [i for i, _ in rows], np.array([x for _, x in rows])
    assert labels(spark, rows, 0.6, 4, 5, dist) == plain_dbscan(ids, X, 0.6, 4, 5, dist)


@pytest.mark.parametrize("d", [1, 4])
def test_other_dimensions(spark, d, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 4)
    rng = random.Random(d)
    rows = [(i, tuple(rng.gauss(3 * (i % 3), 0.7) for _ in range(d))) for i in range(150)]
    ids, X = [i for i, _ in rows], np.array([x for _, x in rows])
    radius = 0.1 if d == 1 else 0.45 * math.sqrt(d)
    assert labels(spark, rows, radius, 3, 2) == plain_dbscan(ids, X, radius, 3, 2, EUCLID)


def test_hot_point_and_dense_cell(spark, monkeypatch):
    """A third of the rows at one point, a cell with far more points than a block, a chain between cells, exact borders."""
    monkeypatch.setattr(density, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(i, (1.0, 1.0)) for i in range(300)]
    rows += [(300 + i, (5 + rng.random() * 0.5, 5 + rng.random() * 0.5)) for i in range(400)]
    rows += [(700 + i, (5.5 + 0.9 * i, 5.25)) for i in range(12)]
    rows += [(800 + i, (float(i), 20.0)) for i in range(30)]  # integers exactly one radius apart
    rows += [(900, (-50.0, -50.0)), (901, (-50.0, -49.5)), (902, (90.0, 90.0))]
    ids, X = [i for i, _ in rows], np.array([x for _, x in rows])
    assert labels(spark, rows, 1.0, 2, 3) == plain_dbscan(ids, X, 1.0, 2, 3, EUCLID)


def test_border_point_between_two_clusters_counts_for_both(spark):
    left, right = [(10 + i, (-1.0 - 0.01 * i, 0.0)) for i in range(4)], [(1 + i, (1.0 + 0.01 * i, 0.0)) for i in range(4)]
    rows = [*left, *right, (50, (0.0, 0.0))]
    ids, X = [i for i, _ in rows], np.array([x for _, x in rows])
    for size, want in ((5, 1), (6, 0)):
        got = labels(spark, rows, 1.0, 3, size)
        assert got == plain_dbscan(ids, X, 1.0, 3, size, EUCLID)
        assert got[50] == want


def test_no_pair_of_points_is_listed(spark):
    """10,000 equal points and 3,000 near ones: no operator gives more rows than a few per point."""
    df = spark.range(13_000).select("id", F.array(F.when(F.col("id") < 10_000, F.lit(0.0)).otherwise(F.col("id") / 1e6), F.lit(0.0)).alias("x"))
    assert {r.label for r in density.dbscan_points(df, 1.0, 5).collect()} == {1}


def test_empty_and_bad_points(spark):
    none = spark.createDataFrame([], "id bigint, x array<double>")
    assert density.dbscan_points(none, 1.0).collect() == []
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, x array<double>")
    with pytest.raises(ValueError, match="coordinates"):
        density.dbscan_points(mixed, 1.0)


def test_card_round_trip_state_and_rows_without_points(spark, tmp_path):
    config = {"type": "cluster", "method": {"type": "dbscan", "radius": 0.5, "min_neighbors": 2, "dissimilarity": {"type": "cityblock"}},
              "inputs": ["x", "y"], "partition": "part", "weights": "id"}
    card = card_from_dict(config)
    assert card == card_from_dict(card.to_dict())
    assert card.method.dissimilarity.type == "cityblock"
    rows = [(i, i * 0.2, 0.0, 1) for i in range(5)] + [(10, None, 0.0, 1), (11, float("nan"), 0.0, 1), (12, 0.2, 0.0, 2), (13, 9.0, 9.0, 1), (14, 0.1, 0.0, None)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, part int")
    node = Node(card)
    with pytest.warns(UserWarning, match="ignores weights"):
        node.fit(df, "id")
    node.save(str(tmp_path / "node"))
    again = Node.load(spark, str(tmp_path / "node"))
    want = {**dict.fromkeys(range(5), 1), 10: None, 11: None, 12: None, 13: 0, 14: None}
    for n in (node, again):
        assert {r.id: r.cluster for r in n.evaluate(df, "id").collect()} == want
    old = df.withColumn("cluster", F.lit(77))
    assert {r.id: r.cluster for r in node.evaluate(old, "id").collect()} == {**want, 12: 77, 14: 77}
    assert node.report() == {"clusters": 1}
    for bad in ({"radius": 0}, {"radius": 1, "min_neighbors": 0}, {"radius": 1, "dissimilarity": Dissimilarity("sqeuclidean")}):
        with pytest.raises(ValueError):
            DBSCANMethod(**bad)
    assert ClusterCard(DBSCANMethod(1.0), inputs=("x",)).output == "cluster"


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    df = spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a bigint, b bigint")
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_rounds_are_planned_from_their_own_size(spark):
    """The plan's estimated size does not become the product of all rounds' joins: planning a round would take ever longer."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    found = components(chain)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(101)}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40

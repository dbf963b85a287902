"""Table summaries, page indexes and shuffled batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cardinal.operators import funnel
from cardinal.operators.summary import summarize, summary_table
from cardinal.plans import dashboard
from cardinal.plans.dashboard import PageIndex, fetch_page, load_and_summarize
from cardinal.sources.tables import json_array_page
from tests.conftest import table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_orders_values_by_their_type_with_null_last(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'b', DATE '2024-02-01', true, TIMESTAMP '2024-01-01 09:00:00', 1.5),
      (10, 'a', DATE '2023-12-31', false, TIMESTAMP '2024-01-01 10:00:00', NULL), (9, NULL, NULL, NULL, NULL, NULL),
      (9, 'b', DATE '2024-02-01', true, TIMESTAMP '2024-01-01 09:00:00', -2.0) AS t(n, `s.t`, d, b, ts, x)""")
    got = summary_table(df).collect()
    lists = {}
    for r in sorted((r for r in got if r.kind == "categorical"), key=lambda r: (r.name, r.position)):
        lists.setdefault(r.name, []).append(r.value)
    assert lists == {"s.t": ["a", "b", None], "d": ["2023-12-31", "2024-02-01", None], "b": ["false", "true", None],
                     "ts": ["2024-01-01 09:00:00", "2024-01-01 10:00:00", None]}
    assert {(r.name, r.eltype, r.low, r.high) for r in got if r.kind == "numerical"} == {("n", "int", 1.0, 10.0), ("x", "float", -2.0, 1.5)}
    assert {r.name: r.column_no for r in got} == {c: i for i, c in enumerate(df.columns, 1)}
    parts = {c.name: c for c in summarize(df)}
    assert parts["s.t"].head(2) == ["a", "b"]
    assert parts["n"].summary == {"min": 1, "max": 10}
    assert summary_table(df.select("n").limit(0)).collect()[0][4:] == (None, None, None, None)
    assert summary_table(df.select("`s.t`").limit(0)).collect() == []


def test_loading_and_summarising_collects_no_values(spark, tmp_path):
    spark.range(3000).selectExpr("id", "concat('text ', id) AS t").write.parquet(str(tmp_path / "x.parquet"))
    df, parts = load_and_summarize(spark, {"files": [str(tmp_path / "x.parquet")], "format": "parquet"})
    assert parts[1].values.count() == df.count() == 3000
    assert parts[1].summary is None


def test_pages_of_an_index(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("v"), F.col("id"))
    want = sorted(((r.k, r.v, r.id) for r in df.collect()), key=lambda r: (r[1] is None, -(r[1] or 0), r[0], r[2]))
    sort = [{"colId": "v", "sort": "desc"}, {"colId": "k"}, {"colId": "id", "sort": "asc"}, {"colId": "nothing"}]
    with PageIndex(df, sort, slice_rows=60) as index:
        path = index.path.removeprefix("file:")
        for limit, offset in ((10, 0), (25, 590), (300, 650), (50, 980), (5, 1000), (0, 3)):
            assert [tuple(r) for r in index.page(limit, offset).collect()] == want[offset:offset + limit]
        deep = index.page(20, 900)
        assert len(index.counts) > 10
        assert "PartitionFilters: [" in plan_of(deep)
        assert deep._jdf.queryExecution().optimizedPlan().toString().count("_cd_slice") > 0
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def test_ties_and_unsorted_pages_neither_repeat_nor_miss_rows(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id")
    for sort in ([{"colId": "k"}], []):
        with PageIndex(df, sort, slice_rows=40) as index:
            seen = [r.id for at in range(0, 500, 70) for r in index.page(70, at).collect()]
        assert sorted(seen) == list(range(500))


def test_deep_pages_use_the_index(spark, monkeypatch):
    monkeypatch.setattr(dashboard, "SLICE_ROWS", 100)
    orders = table(spark, "orders")
    page, total = fetch_page(orders, 5, 9000, [{"colId": "o_orderkey"}])
    keys = sorted(r.o_orderkey for r in orders.select("o_orderkey").collect())
    assert ([r.o_orderkey for r in page.collect()], total) == (keys[9000:9005], len(keys))


def test_json_page_is_bounded(spark):
    assert len(json.loads(json_array_page(spark.range(5)).first()[0])) == 5
    with pytest.raises(Exception, match="more than 10 rows"):
        json_array_page(spark.range(11), 10).collect()


def batches(df, **kw):
    got = {}
    for r in funnel.shuffled_batches(df, ["id"], 32, **kw).collect():
        got.setdefault(r[funnel.BATCH], set()).add(r.id)
    return got


def test_shuffled_batches(spark, monkeypatch):
    monkeypatch.setattr(funnel, "BUCKET_ROWS", 90)  # several buckets
    df = spark.range(1000).withColumn("x", F.col("id") * 2.0)
    one = batches(df, seed=1)
    assert sorted(one) == list(range(32))
    assert [len(one[b]) for b in range(32)] == [32] * 31 + [8]
    assert set().union(*one.values()) == set(range(1000))
    assert batches(df.repartition(7), seed=1) == one
    assert batches(df, seed=2) != one
    assert batches(df, seed=1, epoch=1) != one
    assert batches(df) != batches(df)
    assert batches(df.limit(0), seed=1) == {}
    # No order is left: the first batch is spread over the whole range of ids.
    assert max(one[0]) - min(one[0]) > 500


def test_shuffled_batches_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (None, 1.0)] * 20, "id long, x double")
    got = funnel.shuffled_batches(df, ["id"], 32, seed=1).groupBy(funnel.BATCH).count().collect()
    assert sorted(r["count"] for r in got) == [16, 32, 32]
    with pytest.raises(ValueError):
        funnel.shuffled_batches(df, ["id"], 0)


def test_shuffled_batches_rank_no_ranges(spark):
    plan = plan_of(funnel.shuffled_batches(table(spark, "events"), ["event_id"], 32, seed=1))
    assert plan.count("rangepartitioning") == 0


def test_slices_of_an_index_do_not_grow_with_the_rows(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 3).alias("t"))
    most = dashboard.SLICES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for sort, key in (([{"colId": "k"}], lambda r: r[0]), ([{"colId": "t"}, {"colId": "k", "sort": "desc"}], lambda r: (r[1], -r[0]))):
        want = sorted((tuple(r) for r in df.collect()), key=key)
        with PageIndex(df, sort, slice_rows=5) as index:
            assert len(index.counts) <= most and index.total == 3000
            for limit, offset in ((10, 0), (7, 1234), (900, 1500), (50, 2990), (3000, 0), (1, 2999), (5, 4000)):
                assert [tuple(r) for r in index.page(limit, offset).collect()] == want[offset:offset + limit]
    with PageIndex(df.limit(0), [{"colId": "k"}], slice_rows=5) as index:
        assert index.total == 0 and index.page(5, 0).collect() == []

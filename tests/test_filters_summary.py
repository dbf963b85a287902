import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardinal.operators.filters import IntervalFilter, ListFilter, filter_from_dict, select, split_rows, training_rows
from cardinal.operators.summary import summarize
from tests.conftest import table


def test_interval_list_none_empty(spark):
    o = table(spark, "orders")
    n = o.count()
    assert select(o, []).count() == n
    assert select(o, [ListFilter("o_orderstatus", ())]).count() == 0
    both = select(o, [IntervalFilter("o_totalprice", 1e4, 2e5), ListFilter("o_orderstatus", ("F",))])
    exp = o.where(F.col("o_totalprice").between(1e4, 2e5) & (F.col("o_orderstatus") == "F")).count()
    assert both.count() == exp


def test_missing_in_list_is_error():
    with pytest.raises(ValueError):
        ListFilter("x", (1, None))


def test_filter_from_config(spark):
    f = filter_from_dict({"type": "interval", "colname": "o_orderdate",
                          "interval": {"min": dt.datetime(1995, 1, 1), "max": dt.datetime(1995, 12, 31)}})
    g = filter_from_dict({"type": "list", "colname": "o_orderpriority", "list": ["1-URGENT", "5-LOW"]})
    assert select(table(spark, "orders"), [f, g]).count() > 0
    with pytest.raises(ValueError):
        filter_from_dict({"type": "range"})


def test_pushdown(spark):
    q = select(table(spark, "orders"), [IntervalFilter("o_totalprice", 1.0, 2.0)]).select("o_orderkey")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_totalprice" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_split_filters(spark):
    df = spark.range(10).withColumn("p", (F.col("id") % 2 + 1).cast("int"))
    assert training_rows(df, "p").count() == 5
    assert training_rows(df, None).count() == 10
    assert split_rows(df, None, 2).count() == 0


def test_summary_nulls_last(spark):
    df = spark.createDataFrame([(1, "b", True), (2, None, False), (None, "a", None)], "x int, s string, b boolean")
    s = {c.name: c for c in summarize(df)}
    assert s["x"].kind == "numerical" and s["x"].summary == {"min": 1, "max": 2}
    assert s["s"].head(9) == ["a", "b", None]
    assert s["b"].kind == "categorical" and s["b"].head(9) == [False, True, None]

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardinal.operators import ranking
from cardinal.operators.ranking import N, RANK, RN, ordered_numbers
from tests.conftest import table


def _ref(pdf, group, order, tie):
    """Brute-force SQL semantics in pandas: NULLS LAST, rank on order keys only."""
    import duckdb

    part = f"PARTITION BY {', '.join(group)}" if group else ""
    return duckdb.sql(
        f"SELECT id, row_number() OVER (w ORDER BY {', '.join(order + tie)}) AS rn, "
        f"rank() OVER (w ORDER BY {', '.join(order)}) AS rk, count(*) OVER (w) AS n "
        f"FROM pdf WINDOW w AS ({part})").df().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("source", ["rows", "files"])
@pytest.mark.parametrize("P", [1, 3, 16])
@pytest.mark.parametrize("group", [[], ["g"], ["g", "d"]])
def test_hot_group_nulls_and_ties(spark, tmp_path, P, group, source):
    # one hot group with a third of the rows, NULL group keys, NULL and tied order keys
    rows = []
    for i in range(600):
        g = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"g{i % 5}")
        v = None if i % 11 == 0 else (i % 13)
        rows.append((i, g, v, [0.0, float("nan"), None, -1.5][i % 4]))
    pdf = pd.DataFrame(rows, columns=["id", "g", "v", "d"])
    df = spark.createDataFrame(rows, "id long, g string, v long, d double")
    if source == "files":
        df.repartition(5).write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    assert ranking.repeatable(df) == (source == "files")
    out = ordered_numbers(df, ["v"], group, tiebreak=["id"], num_partitions=P)
    got = out.select("id", F.col(RN).alias("rn"), F.col(RANK).alias("rk"), F.col(N).alias("n")).toPandas()
    got = got.sort_values("id").reset_index(drop=True)
    pdf["d"] = [{0: "a", 1: "nan", 2: None, 3: "b"}[i % 4] for i in range(600)]  # pandas has one mark for NaN and NULL
    exp = _ref(pdf, group, ["v"], ["id"])
    assert got[["rn", "rk", "n"]].astype("int64").equals(exp[["rn", "rk", "n"]].astype("int64"))


def test_files_are_exchanged_once_and_not_written(spark):
    ev = table(spark, "events").where("user_id is not null")
    plan = ranking.window_function(ev, "rank", ["ts"], output="r", tiebreak=["event_id"])
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    assert "FileScan" in plan and "PushedFilters: [IsNotNull(user_id)]" in plan


def test_sources_that_may_differ_between_runs_are_written_once(spark):
    ev = table(spark, "events")
    assert ranking.repeatable(ev.where("event_id > 3").select("event_id", "ts"))
    assert not ranking.repeatable(ev.withColumn("r", F.rand()))
    assert not ranking.repeatable(ev.groupBy("user_id").count())
    assert not ranking.repeatable(ev.sample(0.5))
    assert not ranking.repeatable(ev.limit(5))


@pytest.mark.parametrize("rows", [0, 1])
def test_few_rows_of_a_file(spark, tmp_path, rows):
    spark.range(rows).withColumn("v", F.lit("x")).write.parquet(str(tmp_path / "t"))
    out = ordered_numbers(spark.read.parquet(str(tmp_path / "t")), ["v"], tiebreak=["id"])
    assert [tuple(r) for r in out.select(RN, RANK, N).collect()] == [(1, 1, 1)] * rows


def test_all_rows_tied(spark, tmp_path):
    spark.range(5000).withColumn("v", F.lit(None).cast("int")).write.parquet(str(tmp_path / "t"))
    out = ordered_numbers(spark.read.parquet(str(tmp_path / "t")), ["v"], ["v"], tiebreak=["id"], num_partitions=7)
    got = out.agg(F.sum((F.col(RN) == F.col("id") + 1).cast("int")), F.min(RANK), F.max(RANK), F.min(N), F.max(N)).first()
    assert tuple(got) == (5000, 1, 1, 5000, 5000)


def test_no_single_partition_exchange(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 17)
    out = ranking.window_function(df, "percent_rank", ["v"], output="p", tiebreak=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_ntile_and_tiles(spark, con):
    from tests.conftest import table

    ev = table(spark, "events")
    got = ranking.tiles_split(ev, [1, 1, 2], ["ts", "event_id"], ["user_id"], repeat=2, tail=1,
                              tiebreak=["event_id"]).select("event_id", "partition").toPandas()
    exp = con.sql("SELECT event_id, list_extract([1,1,2], ((ntile(7) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
                  " - 1) % 3) + 1) AS partition FROM events").df()
    m = got.merge(exp, on="event_id")
    assert len(m) == len(exp) and (m.partition_x == m.partition_y).all()


def test_tiles_validation():
    with pytest.raises(ValueError):
        ranking.tiles_split(None, [3], ["x"])
    with pytest.raises(ValueError):
        ranking.percentile_split(None, 1.5, ["x"])


def test_row_id_scan_order(spark):
    df = spark.range(0, 100, 1, 7).withColumn("k", F.col("id") * 2)
    got = ranking.add_row_id(df, "_id").select("_id").toPandas()["_id"].sort_values().tolist()
    assert got == list(range(1, 101))


# -- row ids in file order ---------------------------------------------------

def numbered(frame):
    return {r.k: r._id for r in frame.select("k", "_id").collect()}


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_file_row_ids_follow_paths_and_rows(spark, tmp_path, fmt):
    """Several files, several splits of a file: the ids are those of reading one file after the other."""
    rng = random.Random(1)
    for name in ("b", "a", "c"):
        keys = [f"{name}{i:04d}" for i in range(rng.randint(300, 900))]
        rng.shuffle(keys)
        frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long").coalesce(1)
        frame.write.mode("overwrite").option("header", True).format(fmt).save(str(tmp_path / "in" / f"part={name}"))
    source = spark.read.option("header", True).format(fmt).load(str(tmp_path / "in"))
    want, at = {}, 0
    for name in ("a", "b", "c"):
        rows = [(int(r.v), r.k) for r in source.where(F.col("part") == name).collect()]
        want |= {k: at + v + 1 for v, k in rows}
        at += len(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        ids = ranking.add_row_id(source.withColumn("w", F.col("v") * 2), "_id")
        assert numbered(ids) == want
        late = {r.k for r in source.where("v > 250").collect()}
        assert numbered(ids.where("v > 250")) == {k: i for k, i in want.items() if k in late}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_row_ids_neither_copy_nor_shuffle_the_rows(spark):
    li = ranking.add_row_id(table(spark, "lineitem"), "_id").where("l_quantity > 49")
    plan = li._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = plan[plan.index("lineitem.parquet"):]
    assert "GreaterThan(l_quantity,49.0)" in scan.split("ReadSchema")[0]
    assert "hashpartitioning" not in plan
    assert "rangepartitioning" not in plan


def test_row_ids_above_a_filter_number_its_rows(spark):
    part = table(spark, "orders").where("o_totalprice > 100000")
    assert not ranking.plain_scan(part)
    ids = sorted(r._id for r in ranking.add_row_id(part, "_id").select("_id").collect())
    assert ids == list(range(1, len(ids) + 1))

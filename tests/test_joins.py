from pyspark.sql import functions as F

from cardinal.operators import joins


def test_measured_counts_texts_and_nested_values(spark):
    df = spark.range(100).withColumn("s", F.lit("\u00e9" * 500)).withColumn("a", F.array_repeat(F.lit(7), 50))
    rows, size = joins.measured(df)
    assert rows == 100 and size >= 100 * (3 * joins.FIELD_BYTES + 1000 + 100)
    assert joins.measured(df.select("id")) == (100, 100 * joins.FIELD_BYTES)
    assert joins.measured(df.limit(0)) == (0, 0)
    assert joins.measured(df.withColumn("s", F.lit(None).cast("string")).select("s")) == (100, 100 * joins.FIELD_BYTES)


def test_wide_rows_are_not_broadcast(spark):
    df = spark.range(50).withColumn("s", F.repeat(F.lit("x"), 10_000))
    assert joins.broadcast_if_bounded(df)[1]
    assert not joins.broadcast_if_bounded(df, max_bytes=400_000)[1]
    assert not joins.broadcast_if_bounded(df, max_rows=49)[1]


def test_statistics_of_long_keys_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins.broadcast_if_bounded, "__defaults__", (joins.BROADCAST_MAX_ROWS, 500))
    df = spark.range(60).withColumn("k", F.concat(F.repeat(F.lit("k"), 300), (F.col("id") % 3).cast("string")))
    stats = df.groupBy("k").agg(F.avg("id").alias("m"))
    out, cols = joins.join_stats(df, stats, ["k"])
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()
    got = {r[0]: r[1] for r in out.select("id", cols["m"]).collect()}
    assert got == {i: (i % 3) + 28.5 for i in range(60)}

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cardinal.functions.metrics import label_smoothing
from cardinal.operators import funnel
from cardinal.operators.rescale import RescaleCard
from cardinal.operators.split import PercentileMethod, SplitCard
from cardinal.plans.flow import CardGraph, Node
from cardinal.sources import tables
from tests.conftest import table


def test_batch_counts_and_map_batches(spark):
    ev = table(spark, "events").withColumn("p", F.when(F.col("event_id") % 5 == 0, 2).otherwise(1))
    counts = funnel.batch_counts(ev, "p", 32)
    n1 = ev.where("p = 1").count()
    assert counts[1] == {"rows": n1, "batches": -(-n1 // 32)}
    assert funnel.batch_counts(ev, None, 32)[2]["rows"] == 0
    b = funnel.with_batches(ev.where("p = 1"), ["ts", "event_id"], 32, tiebreak=["event_id"])

    def stats(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch": [int(pdf["_batch"].iloc[0])], "n": [len(pdf)]})

    out = funnel.map_batches(b, stats, "batch long, n long").toPandas().sort_values("batch")
    assert out.n.max() == 32 and out.n.sum() == n1 and len(out) == counts[1]["batches"]
    shuffled = funnel.with_batches(ev, ["event_id"], 100, tiebreak=["event_id"], shuffle_seed=3)
    assert shuffled.groupBy("_batch").count().agg(F.max("count")).first()[0] == 100


def test_scoped_view_append_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    with tables.with_view(df) as name:
        assert spark.table(name).count() == 1
    assert not spark.catalog.tableExists(name)
    assert tables.column_types(df) == {"x": "bigint", "y": "string"}
    tables.replace_table(spark, df, "appendable")
    tables.append_rows(spark.createDataFrame([(2, "b")], "x long, y string"), "appendable")
    assert sorted(r.x for r in spark.table("appendable").collect()) == [1, 2]
    tables.delete_table(spark, "appendable")
    empty = tables.initialize_table(spark, ["i", "j"], ["bigint", "double"])
    assert empty.count() == 0 and empty.columns == ["i", "j"]


def test_label_smoothing(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0)], "a double, b double, c double")
    got = df.select(*label_smoothing([F.col("a"), F.col("b"), F.col("c")], 0.3)).first()
    assert np.allclose(list(got), [0.7 + 0.1, 0.1, 0.1])


def test_incremental_evaluation_uses_saved_state(spark):
    ev = table(spark, "events")
    nodes = [Node(SplitCard(PercentileMethod(0.8), order_by=("ts",))),
             Node(RescaleCard("zscore", inputs=("value",), partition="partition"))]
    g = CardGraph(nodes)
    full = g.train_evaljoin(ev, "event_id").select("event_id", "value_rescaled")
    nodes[0].update = False
    nodes[1].update = False
    assert g.update_heights() == [-1, -1]
    again = CardGraph(nodes).evaljoin(ev, "event_id").select("event_id", "value_rescaled")
    assert again.exceptAll(full).count() == 0

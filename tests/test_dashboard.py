import json

from pyspark.sql import functions as F

from cardinal.operators.filters import IntervalFilter, ListFilter
from cardinal.operators.rescale import RescaleCard
from cardinal.operators.split import PercentileMethod, SplitCard
from cardinal.plans.dashboard import fetch_page, process
from cardinal.sources.tables import json_array_page
from tests.conftest import table


def test_process_numbers_rows_before_filtering(spark):
    o = table(spark, "orders")
    out = process(o, [IntervalFilter("o_totalprice", 1e4, 2e5), ListFilter("o_orderstatus", ("F", "O"))],
                  [SplitCard(PercentileMethod(0.9), order_by=("o_orderdate",)),
                   RescaleCard("zscore", inputs=("o_totalprice",), partition="partition")],
                  order_rows_by=["o_orderkey"])
    # ids come from the unfiltered table: id k is the k-th smallest order key overall
    ranks = {r.o_orderkey: i + 1 for i, r in enumerate(o.select("o_orderkey").orderBy("o_orderkey").collect())}
    got = out.select("o_orderkey", "_id", "partition", "o_totalprice_rescaled").collect()
    assert all(ranks[r.o_orderkey] == r._id for r in got)
    assert len(got) == o.where(F.col("o_totalprice").between(1e4, 2e5) & F.col("o_orderstatus").isin("F", "O")).count()
    assert {r.partition for r in got} == {1, 2}


def test_fetch_page_and_json(spark):
    o = table(spark, "orders")
    page, total = fetch_page(o, 5, 10, [{"colId": "o_totalprice", "sort": "desc"}, {"colId": "missing"}])
    rows = page.select("o_orderkey", "o_totalprice").collect()
    exp = o.orderBy(F.col("o_totalprice").desc_nulls_last()).select("o_orderkey", "o_totalprice").collect()[10:15]
    assert [r.o_totalprice for r in rows] == [r.o_totalprice for r in exp] and total == o.count()
    doc = json.loads(json_array_page(page.select("o_orderkey", "o_orderstatus")).first()[0])
    assert len(doc) == 5 and set(doc[0]) == {"o_orderkey", "o_orderstatus"}


def test_network_finetune_continues(spark):
    from cardinal.operators import nn

    li = table(spark, "lineitem").withColumn("rid", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    card = nn.DenseNetCard(inputs=("l_discount", "l_tax"), targets=("l_quantity",), order_by=("rid",),
                           layers=({"features": 3, "sigma": "relu"}, {"sigma": "identity"}),
                           training=nn.Training(eta=0.05, epochs=2, seed=3))
    st = card.fit(li, "rid")
    st2 = card.fit(li, "rid", warm=st)
    assert st2.content["epoch"] > st.content["epoch"] or st2.content["epoch"] == st.content["epoch"]
    assert len(st2.content["history"]) == len(st.content["history"]) + 4

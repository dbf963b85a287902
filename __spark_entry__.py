"""

Every query reads the given parquet tables whole (no id subsets, no row
caps; a limit appears only where paging is the feature) and runs through
the library's operators.  ``oracle_sql()`` gives the same result in
DuckDB SQL with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinal.operators import ranking
from cardinal.operators.filters import IntervalFilter, ListFilter, select
from cardinal.operators.gaussian import GaussianEncodingCard
from cardinal.operators.joins import update_join
from cardinal.operators.rescale import RescaleCard
from cardinal.operators.split import PercentileMethod, SplitCard, TilesMethod, WindowFunctionCard
from cardinal.operators.summary import distinct_values, numeric_extrema
from cardinal.plans.dashboard import fetch_page
from cardinal.plans.flow import CardGraph, Node

SF_SMOKE = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# Flagship: filters -> grouped percentile split -> zscore fitted on split 1
# ---------------------------------------------------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    selected = select(orders, [IntervalFilter("o_totalprice", 10000.0, 400000.0), ListFilter("o_orderstatus", ("F", "O"))])
    cards = [
        SplitCard(PercentileMethod(0.8), order_by=("o_orderdate",), group_by=("o_orderpriority",)),
        RescaleCard("zscore", inputs=("o_totalprice",), group_by=("o_orderpriority",), partition="partition"),
    ]
    out = CardGraph([Node(c) for c in cards]).train_evaljoin(selected, "o_orderkey")
    return out.select("o_orderkey", "o_orderpriority", "partition", "o_totalprice_rescaled")


FLAGSHIP_SQL = """
WITH sel AS (
  SELECT * FROM orders WHERE o_totalprice BETWEEN 10000.0 AND 400000.0 AND o_orderstatus IN ('F', 'O')
), sp AS (
  SELECT *, CASE WHEN percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) <= 0.8
                 THEN 1 ELSE 2 END AS "partition"
  FROM sel
), st AS (
  SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s
  FROM sp WHERE "partition" = 1 GROUP BY o_orderpriority
)
SELECT sp.o_orderkey, sp.o_orderpriority, sp."partition", (sp.o_totalprice - st.m) / st.s AS o_totalprice_rescaled
FROM sp LEFT JOIN st ON sp.o_orderpriority = st.o_orderpriority
"""


def entry(spark: SparkSession) -> DataFrame:
    return flagship(spark, SF_SMOKE)


# ---------------------------------------------------------------------------
# Filters (F1-F4) and summaries
# ---------------------------------------------------------------------------

def filter_interval(spark, d):
    return select(_t(spark, d, "orders"), [IntervalFilter("o_totalprice", 50000.0, 150000.0)]).select("o_orderkey", "o_totalprice")


def filter_interval_dates(spark, d):
    import datetime as dt

    f = IntervalFilter("o_orderdate", dt.datetime(1994, 1, 1), dt.datetime(1995, 6, 30))
    return select(_t(spark, d, "orders"), [f]).select("o_orderkey", "o_orderstatus")


def filter_list(spark, d):
    return select(_t(spark, d, "orders"), [ListFilter("o_orderstatus", ("F", "P"))]).select("o_orderkey", "o_orderstatus")


def filter_empty_list(spark, d):
    return select(_t(spark, d, "orders"), [ListFilter("o_orderstatus", ())]).select("o_orderkey")


def filter_none(spark, d):
    return select(_t(spark, d, "orders"), []).select("o_orderkey")


def filter_conjunction(spark, d):
    fs = [IntervalFilter("value", 5.0, 50.0), ListFilter("event_type", ("click", "view", "purchase"))]
    return select(_t(spark, d, "events"), fs).select("event_id", "event_type", "value")


def summary_numeric(spark, d):
    return numeric_extrema(_t(spark, d, "events"), ["event_id", "user_id", "value"])


def summary_categorical(spark, d):
    return distinct_values(_t(spark, d, "events"), "event_type")


# ---------------------------------------------------------------------------
# Windows and splits
# ---------------------------------------------------------------------------

def _card_eval(card, df, id_var):
    return CardGraph([Node(card)]).train_evaljoin(df, id_var)


def win_rank(spark, d):
    c = WindowFunctionCard("rank", order_by=("value",), group_by=("user_id",), output="rnk")
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "rnk")


def win_percent_rank(spark, d):
    c = WindowFunctionCard("percent_rank", order_by=("value",), group_by=("event_type",), output="prank")
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "prank")


def win_row_number(spark, d):
    c = WindowFunctionCard("row_number", order_by=("ts", "event_id"), group_by=("user_id",), output="rn")
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "rn")


def win_rank_global(spark, d):
    c = WindowFunctionCard("rank", order_by=("o_orderdate",), output="rnk")
    return _card_eval(c, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "rnk")


def win_percent_rank_global(spark, d):
    c = WindowFunctionCard("percent_rank", order_by=("l_shipdate",), output="prank")
    li = _t(spark, d, "lineitem")
    return _card_eval(c, li, None).select("l_orderkey", "l_linenumber", "prank")


def win_row_number_global(spark, d):
    c = WindowFunctionCard("row_number", order_by=("o_orderdate", "o_orderkey"), output="rn")
    return _card_eval(c, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "rn")


def split_percentile(spark, d):
    c = SplitCard(PercentileMethod(0.9), order_by=("ts",), group_by=("event_type",))
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "partition")


def split_percentile_global(spark, d):
    c = SplitCard(PercentileMethod(0.6), order_by=("o_orderdate",))
    return _card_eval(c, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "partition")


def split_tiles(spark, d):
    c = SplitCard(TilesMethod((1, 1, 2), repeat=2, tail=1), order_by=("ts", "event_id"), group_by=("user_id",))
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "partition")


def split_tiles_global(spark, d):
    c = SplitCard(TilesMethod((1, 1, 2, 1, 1, 2)), order_by=("o_orderdate", "o_orderkey"))
    return _card_eval(c, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "partition")


def ntile_lineitem(spark, d):
    li = _t(spark, d, "lineitem")
    out = ranking.ntile(li, 10, order_by=("l_extendedprice", "l_orderkey", "l_linenumber"),
                        group_by=("l_returnflag",), output="decile", tiebreak=["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "decile")


def row_id(spark, d):
    return ranking.add_row_id(_t(spark, d, "orders"), "_id", order_by=["o_orderkey"]).select("o_orderkey", "_id")


# ---------------------------------------------------------------------------
# Rescale (R1-R6)
# ---------------------------------------------------------------------------

def rescale_zscore(spark, d):
    c = RescaleCard("zscore", inputs=("value",), group_by=("event_type",))
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "value_rescaled")


def rescale_zscore_global(spark, d):
    c = RescaleCard("zscore", inputs=("l_quantity", "l_extendedprice"))
    return _card_eval(c, _t(spark, d, "lineitem"), None).select(
        "l_orderkey", "l_linenumber", "l_quantity_rescaled", "l_extendedprice_rescaled")


def rescale_maxabs(spark, d):
    c = RescaleCard("maxabs", inputs=("c_acctbal",), group_by=("c_mktsegment", "c_nationkey"))
    return _card_eval(c, _t(spark, d, "customer"), "c_custkey").select("c_custkey", "c_acctbal_rescaled")


def rescale_minmax(spark, d):
    c = RescaleCard("minmax", inputs=("o_totalprice",), group_by=("o_orderstatus",))
    return _card_eval(c, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice_rescaled")


def rescale_log(spark, d):
    c = RescaleCard("log", inputs=("value",))
    return _card_eval(c, _t(spark, d, "events"), "event_id").select("event_id", "value_rescaled")


def rescale_logistic(spark, d):
    c = RescaleCard("logistic", inputs=("l_discount", "l_tax"))
    return _card_eval(c, _t(spark, d, "lineitem"), None).select(
        "l_orderkey", "l_linenumber", "l_discount_rescaled", "l_tax_rescaled")


def rescale_zscore_inverse(spark, d):
    """Fit on split 1, rescale the target, then invert it back."""
    c = RescaleCard("zscore", targets=("value",), group_by=("event_type",), partition="partition")
    split = SplitCard(PercentileMethod(0.7), order_by=("ts",), group_by=("event_type",))
    node = Node(c)
    g = CardGraph([Node(split), node])
    fwd = g.train_evaljoin(_t(spark, d, "events"), "event_id")
    inv = node.invert().evaluate(fwd.withColumnRenamed("value", "value_orig"), "event_id")
    return inv.select("event_id", "value_rescaled", F.col("value").alias("value_back"))


# ---------------------------------------------------------------------------
# Gaussian encodings
# ---------------------------------------------------------------------------

def _gauss(spark, d, method, n, max_=None, col="ts"):
    c = GaussianEncodingCard(input=col, n_components=n, method=method, max=max_)
    ev = _card_eval(c, _t(spark, d, "events"), "event_id")
    return ev.select("event_id", *c.outputs())


def gauss_identity(spark, d):
    return _gauss(spark, d, "identity", 4, 12.0, col="value")


def gauss_dayofweek(spark, d):
    return _gauss(spark, d, "dayofweek", 3)


def gauss_dayofyear(spark, d):
    return _gauss(spark, d, "dayofyear", 12, 365.0)


def gauss_hourofday(spark, d):
    return _gauss(spark, d, "hourofday", 4)


def gauss_minuteofday(spark, d):
    return _gauss(spark, d, "minuteofday", 6)


def gauss_minuteofhour(spark, d):
    return _gauss(spark, d, "minuteofhour", 2)


# ---------------------------------------------------------------------------
# Update join (J3), paging
# ---------------------------------------------------------------------------

def evaljoin_update_new(spark, d):
    """Labels cover some documents only: the others get NULL."""
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return update_join(docs, _t(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def evaljoin_update_existing(spark, d):
    """Labelled documents get a new value, the others keep theirs."""
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    new = _t(spark, d, "labels").select("doc_id", (-F.col("toxic") - 1).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return update_join(docs, new, "doc_id")


def page_sort_offset(spark, d):
    page, _ = fetch_page(_t(spark, d, "orders"), 50, 10,
                         [{"colId": "o_totalprice", "sort": "desc"}, {"colId": "o_orderkey", "sort": "asc"},
                          {"colId": "no_such_column", "sort": "asc"}])
    return page.select("o_orderkey", "o_totalprice")


def count_rows(spark, d):
    return _t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _reg(name, fn, sql):
    _REGISTRY[name] = (fn, sql)


_reg("flagship", flagship, FLAGSHIP_SQL)
_reg("filter_interval", filter_interval,
     "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000.0 AND 150000.0")
_reg("filter_interval_dates", filter_interval_dates,
     "SELECT o_orderkey, o_orderstatus FROM orders "
     "WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-06-30'")
_reg("filter_list", filter_list, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
_reg("filter_empty_list", filter_empty_list, "SELECT o_orderkey FROM orders WHERE false")
_reg("filter_none", filter_none, "SELECT o_orderkey FROM orders WHERE true")
_reg("filter_conjunction", filter_conjunction,
     "SELECT event_id, event_type, value FROM events "
     "WHERE value BETWEEN 5.0 AND 50.0 AND event_type IN ('click', 'view', 'purchase')")
_reg("summary_numeric", summary_numeric,
     "SELECT min(event_id) AS event_id_min, max(event_id) AS event_id_max, min(user_id) AS user_id_min, "
     "max(user_id) AS user_id_max, min(value) AS value_min, max(value) AS value_max FROM events")
_reg("summary_categorical", summary_categorical, "SELECT DISTINCT event_type FROM events")
_reg("win_rank", win_rank, "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value) AS rnk FROM events")
_reg("win_percent_rank", win_percent_rank,
     "SELECT event_id, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS prank FROM events")
_reg("win_row_number", win_row_number,
     "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
_reg("win_rank_global", win_rank_global, "SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate) AS rnk FROM orders")
_reg("win_percent_rank_global", win_percent_rank_global,
     "SELECT l_orderkey, l_linenumber, percent_rank() OVER (ORDER BY l_shipdate) AS prank FROM lineitem")
_reg("win_row_number_global", win_row_number_global,
     "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
_reg("split_percentile", split_percentile,
     "SELECT event_id, CASE WHEN percent_rank() OVER (PARTITION BY event_type ORDER BY ts) <= 0.9 "
     "THEN 1 ELSE 2 END AS \"partition\" FROM events")
_reg("split_percentile_global", split_percentile_global,
     "SELECT o_orderkey, CASE WHEN percent_rank() OVER (ORDER BY o_orderdate) <= 0.6 "
     "THEN 1 ELSE 2 END AS \"partition\" FROM orders")
_reg("split_tiles", split_tiles,
     "SELECT event_id, list_extract([1, 1, 2], ((ntile(7) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 3) + 1)"
     " AS \"partition\" FROM events")
_reg("split_tiles_global", split_tiles_global,
     "SELECT o_orderkey, list_extract([1, 1, 2, 1, 1, 2], ((ntile(6) OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 6) + 1)"
     " AS \"partition\" FROM orders")
_reg("ntile_lineitem", ntile_lineitem,
     "SELECT l_orderkey, l_linenumber, l_extendedprice, ntile(10) OVER (PARTITION BY l_returnflag "
     "ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS decile FROM lineitem")
_reg("row_id", row_id, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS _id FROM orders")
_reg("rescale_zscore", rescale_zscore,
     "SELECT e.event_id, (e.value - s.m) / s.sd AS value_rescaled FROM events e LEFT JOIN "
     "(SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type) s "
     "ON e.event_type = s.event_type")
_reg("rescale_zscore_global", rescale_zscore_global,
     "SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () "
     "AS l_quantity_rescaled, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () "
     "AS l_extendedprice_rescaled FROM lineitem")
_reg("rescale_maxabs", rescale_maxabs,
     "SELECT c.c_custkey, c.c_acctbal / s.m AS c_acctbal_rescaled FROM customer c LEFT JOIN "
     "(SELECT c_mktsegment, c_nationkey, max(abs(c_acctbal)) AS m FROM customer GROUP BY ALL) s "
     "ON c.c_mktsegment = s.c_mktsegment AND c.c_nationkey = s.c_nationkey")
_reg("rescale_minmax", rescale_minmax,
     "SELECT o.o_orderkey, (o.o_totalprice - s.lo) / (s.hi - s.lo) AS o_totalprice_rescaled FROM orders o LEFT JOIN "
     "(SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL) s "
     "ON o.o_orderstatus = s.o_orderstatus")
_reg("rescale_log", rescale_log, "SELECT event_id, ln(value) AS value_rescaled FROM events")
_reg("rescale_logistic", rescale_logistic,
     "SELECT l_orderkey, l_linenumber, 1.0 / (1.0 + exp(-l_discount)) AS l_discount_rescaled, "
     "1.0 / (1.0 + exp(-l_tax)) AS l_tax_rescaled FROM lineitem")
_reg("rescale_zscore_inverse", rescale_zscore_inverse, """
WITH sp AS (
  SELECT *, CASE WHEN percent_rank() OVER (PARTITION BY event_type ORDER BY ts) <= 0.7 THEN 1 ELSE 2 END AS p
  FROM events
), st AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM sp WHERE p = 1 GROUP BY event_type),
fw AS (SELECT sp.event_id, (sp.value - st.m) / st.sd AS value_rescaled, st.m, st.sd
       FROM sp LEFT JOIN st ON sp.event_type = st.event_type)
SELECT event_id, value_rescaled, m + sd * value_rescaled AS value_back FROM fw
""")


def _gauss_sql(expr: str, n: int, period: float, name: str, lam: float = 0.5) -> str:
    sigma = lam / n
    cols = []
    for i in range(n):
        eta = f"(({expr})::DOUBLE / {period!r}::DOUBLE - {i / n!r}::DOUBLE)"
        cols.append(f"exp(-pow(abs({eta} - round({eta})) / {sigma!r}::DOUBLE, 2) / 2.0::DOUBLE) "
                    f"/ sqrt(2.0::DOUBLE * pi()) AS {name}_gaussian_{i + 1}")
    return f"SELECT event_id, {', '.join(cols)} FROM events"


_reg("gauss_identity", gauss_identity, _gauss_sql("value", 4, 12.0, "value"))
_reg("gauss_dayofweek", gauss_dayofweek, _gauss_sql("dayofweek(ts)", 3, 7.0, "ts"))
_reg("gauss_dayofyear", gauss_dayofyear, _gauss_sql("dayofyear(ts)", 12, 365.0, "ts"))
_reg("gauss_hourofday", gauss_hourofday, _gauss_sql("hour(ts)", 4, 24.0, "ts"))
_reg("gauss_minuteofday", gauss_minuteofday, _gauss_sql("hour(ts) * 60 + minute(ts)", 6, 1440.0, "ts"))
_reg("gauss_minuteofhour", gauss_minuteofhour, _gauss_sql("minute(ts)", 2, 60.0, "ts"))

_reg("evaljoin_update_new", evaljoin_update_new,
     "SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)")
_reg("evaljoin_update_existing", evaljoin_update_existing,
     "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE -toxic - 1 END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
_reg("page_sort_offset", page_sort_offset,
     "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey "
     "LIMIT 50 OFFSET 10")
_reg("count_rows", count_rows, "SELECT count(*) AS n FROM lineitem")


# ---------------------------------------------------------------------------
# Distances + k-means
# ---------------------------------------------------------------------------

from cardinal.functions.distances import Dissimilarity  # noqa: E402
from cardinal.operators.cluster import ClusterCard, DBSCANMethod, KMeansMethod, assign  # noqa: E402
from cardinal.operators.dimred import DimensionalityReductionCard  # noqa: E402
from cardinal.operators.glm import GLMCard  # noqa: E402
from cardinal.operators.interp import InterpCard  # noqa: E402

_KM_DISTS = {
    "sqeuclidean": Dissimilarity("sqeuclidean"),
    "weighted_sqeuclidean": Dissimilarity("weighted_sqeuclidean", weights=(2.0, 0.5)),
    "euclidean": Dissimilarity("euclidean"),
    "cityblock": Dissimilarity("cityblock"),
    "chebyshev": Dissimilarity("chebyshev"),
    "minkowski": Dissimilarity("minkowski", p=3.0),
    "weighted_euclidean": Dissimilarity("weighted_euclidean", weights=(2.0, 0.5)),
    "weighted_cityblock": Dissimilarity("weighted_cityblock", weights=(2.0, 0.5)),
    "weighted_minkowski": Dissimilarity("weighted_minkowski", p=3.0, weights=(2.0, 0.5)),
}


def _kmeans_assign(dist):
    def q(spark, d):
        cust = _t(spark, d, "customer")
        # Centres: mean point of each market segment (5 rows, bounded by the segment count).
        cent = cust.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"), F.avg("c_nationkey").alias("n"))
        import numpy as np

        centres = np.array([[r["a"], r["n"]] for r in cent.orderBy("c_mktsegment").collect()])
        lab = assign([F.col("c_acctbal"), F.col("c_nationkey")], centres, dist)
        return cust.select("c_custkey", lab.cast("bigint").alias("cluster"))
    return q


def _dist_sql(name: str) -> str:
    da, dn = "(c_acctbal - a)", "(c_nationkey - n)"
    w = {"a": "2.0", "n": "0.5"}
    forms = {
        "sqeuclidean": f"{da}*{da} + {dn}*{dn}",
        "weighted_sqeuclidean": f"{w['a']}*{da}*{da} + {w['n']}*{dn}*{dn}",
        "euclidean": f"sqrt({da}*{da} + {dn}*{dn})",
        "cityblock": f"abs({da}) + abs({dn})",
        "chebyshev": f"greatest(abs({da}), abs({dn}))",
        "minkowski": f"pow(pow(abs({da}), 3.0) + pow(abs({dn}), 3.0), 1.0/3.0)",
        "weighted_euclidean": f"sqrt({w['a']}*{da}*{da} + {w['n']}*{dn}*{dn})",
        "weighted_cityblock": f"{w['a']}*abs({da}) + {w['n']}*abs({dn})",
        "weighted_minkowski": f"pow({w['a']}*pow(abs({da}), 3.0) + {w['n']}*pow(abs({dn}), 3.0), 1.0/3.0)",
    }
    return (
        "WITH c AS (SELECT row_number() OVER (ORDER BY c_mktsegment) AS k, avg(c_acctbal) AS a, "
        "avg(c_nationkey) AS n FROM customer GROUP BY c_mktsegment) "
        f"SELECT c_custkey, arg_min(k, {forms[name]}) AS cluster FROM customer JOIN c ON true GROUP BY c_custkey"
    )


def kmeans_fit(spark, d):
    card = ClusterCard(KMeansMethod(4, seed=7), inputs=("c_acctbal", "c_nationkey"))
    return _card_eval(card, _t(spark, d, "customer"), "c_custkey").select("c_custkey", "cluster")


def kmeans_fit_cityblock_weighted(spark, d):
    card = ClusterCard(KMeansMethod(3, seed=1, dissimilarity=Dissimilarity("cityblock")),
                       inputs=("o_totalprice",), weights="o_custkey")
    return _card_eval(card, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "cluster")


def kmeans_fit_embeddings(spark, d):
    card = ClusterCard(KMeansMethod(10, seed=3), inputs=("embedding",))
    return _card_eval(card, _t(spark, d, "embeddings"), "vec_id").select("vec_id", "label", "cluster")


def dbscan_customer(spark, d):
    card = ClusterCard(DBSCANMethod(18.0, min_neighbors=4, min_cluster_size=8), inputs=("c_acctbal", "c_nationkey"))
    return _card_eval(card, _t(spark, d, "customer"), "c_custkey").select("c_custkey", "cluster")


def dbscan_events_cityblock(spark, d):
    """Amount and hour of the events of one split, in weighted city-block distance."""
    ev = _t(spark, d, "events").withColumns({"hour": F.hour("ts"), "part": (F.col("event_id") % 3).cast("int")})
    dist = Dissimilarity("weighted_cityblock", weights=(1.0, 2.0))
    card = ClusterCard(DBSCANMethod(1.0, min_neighbors=9, min_cluster_size=20, dissimilarity=dist), inputs=("value", "hour"), partition="part")
    return _card_eval(card, ev, "event_id").select("event_id", "cluster")


def _dbscan_sql(points: str, rows: str, id_name: str, dist: str, radius: float, min_neighbors: int, min_size: int) -> str:
    return f"""
WITH RECURSIVE p AS ({points}), n AS (
  SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= {radius} AND {dist} <= {radius}
), core AS (
  SELECT a AS id FROM n GROUP BY a HAVING count(*) >= {min_neighbors}
), e AS (
  SELECT n.a, n.b FROM n SEMI JOIN core c ON c.id = n.a SEMI JOIN core k ON k.id = n.b
), r(node, comp) AS (
  SELECT id, id FROM core UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node WHERE r.comp < e.b
), k AS (
  SELECT node AS id, min(comp) AS comp FROM r GROUP BY node
), t AS (
  SELECT id, comp FROM k UNION SELECT n.a, k.comp FROM n JOIN k ON k.id = n.b ANTI JOIN core ON core.id = n.a
), s AS (
  SELECT comp, row_number() OVER (ORDER BY comp) AS label FROM t GROUP BY comp HAVING count(*) >= {min_size}
), l AS (
  SELECT t.id, min(s.label) AS label FROM t JOIN s USING (comp) GROUP BY t.id
)
SELECT q.id AS {id_name}, CASE WHEN mine THEN coalesce(l.label, 0) END AS cluster FROM ({rows}) q LEFT JOIN l ON l.id = q.id"""


# ---------------------------------------------------------------------------
# Dimensionality reduction
# ---------------------------------------------------------------------------

def _dr(method):
    def q(spark, d):
        card = DimensionalityReductionCard(method, inputs=("l_quantity", "l_extendedprice"), n_components=2)
        out = _card_eval(card, _t(spark, d, "lineitem"), None)
        return out.select("l_orderkey", "l_linenumber", "component_1", "component_2")
    return q


PCA_SQL = """
WITH s AS (
  SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, var_pop(l_quantity) AS va,
         var_pop(l_extendedprice) AS vb, covar_pop(l_quantity, l_extendedprice) AS cab FROM lineitem
), t AS (SELECT *, 0.5 * atan2(2 * cab, va - vb) AS th FROM s),
v AS (SELECT ma, mb, cos(th) AS v1a, sin(th) AS v1b, -sin(th) AS v2a, cos(th) AS v2b FROM t),
f AS (SELECT *, CASE WHEN (CASE WHEN abs(v1a) >= abs(v1b) THEN v1a ELSE v1b END) < 0 THEN -1.0 ELSE 1.0 END AS s1,
                CASE WHEN (CASE WHEN abs(v2a) >= abs(v2b) THEN v2a ELSE v2b END) < 0 THEN -1.0 ELSE 1.0 END AS s2
      FROM v)
SELECT l_orderkey, l_linenumber,
       s1 * ((l_quantity - ma) * v1a + (l_extendedprice - mb) * v1b) AS component_1,
       s2 * ((l_quantity - ma) * v2a + (l_extendedprice - mb) * v2b) AS component_2
FROM lineitem JOIN f ON true
"""


def pca_embeddings(spark, d):
    emb = _t(spark, d, "embeddings")
    width = emb.agg(F.max(F.size("embedding"))).first()[0]
    emb = emb.select("vec_id", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(width)])
    card = DimensionalityReductionCard("pca", inputs=tuple(f"e{i}" for i in range(width)), n_components=3)
    return _card_eval(card, emb, "vec_id").select("vec_id", "component_1", "component_2", "component_3")


# ---------------------------------------------------------------------------
# Linear and generalised linear models
# ---------------------------------------------------------------------------

def lm_simple(spark, d):
    card = GLMCard(target="l_extendedprice", formula=(1, "l_quantity"))
    return _card_eval(card, _t(spark, d, "lineitem"), None).select("l_orderkey", "l_linenumber", "l_extendedprice_hat")


def lm_weighted(spark, d):
    card = GLMCard(target="l_extendedprice", formula=(1, "l_discount"), weights="l_quantity")
    return _card_eval(card, _t(spark, d, "lineitem"), None).select("l_orderkey", "l_linenumber", "l_extendedprice_hat")


LM_SIMPLE_SQL = """
WITH s AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1
           FROM lineitem)
SELECT l_orderkey, l_linenumber, b0 + b1 * l_quantity AS l_extendedprice_hat FROM lineitem JOIN s ON true
"""

LM_WEIGHTED_SQL = """
WITH s AS (SELECT sum(l_quantity) AS sw, sum(l_quantity * l_discount) AS swx, sum(l_quantity * l_extendedprice) AS swy,
                  sum(l_quantity * l_discount * l_discount) AS swxx,
                  sum(l_quantity * l_discount * l_extendedprice) AS swxy FROM lineitem),
c AS (SELECT (sw * swxy - swx * swy) / (sw * swxx - swx * swx) AS b1, sw, swx, swy FROM s)
SELECT l_orderkey, l_linenumber, (swy - b1 * swx) / sw + b1 * l_discount AS l_extendedprice_hat
FROM lineitem JOIN c ON true
"""


def lm_categorical(spark, d):
    card = GLMCard(target="l_extendedprice", formula=(1, ("l_returnflag", "l_quantity"), "l_tax"))
    return _card_eval(card, _t(spark, d, "lineitem"), None).select("l_orderkey", "l_linenumber", "l_extendedprice_hat")


def glm_poisson(spark, d):
    card = GLMCard(target="l_quantity", formula=(1, "l_discount", "l_tax"), distribution="poisson")
    return _card_eval(card, _t(spark, d, "lineitem"), None).select("l_orderkey", "l_linenumber", "l_quantity_hat")


def glm_gamma_weighted(spark, d):
    card = GLMCard(target="o_totalprice", formula=(1, "o_orderpriority"), distribution="gamma", link="log",
                   weights="o_custkey")
    return _card_eval(card, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice_hat")


def _glm_by_level(df, target, level, models):
    """One card for each (suffix, family, link, options): fitted values by the levels of one column."""
    for suffix, family, link, more in models:
        card = GLMCard(target=target, formula=(1, level), distribution=family, link=link, suffix=suffix, **more)
        df = _card_eval(card, df, None)
    return df


def glm_binomial_links(spark, d):
    filled = _t(spark, d, "orders").withColumn("filled", (F.col("o_orderstatus") == "F").cast("double"))
    links = ("logit", "probit", "cloglog", "cauchit")
    out = _glm_by_level(filled, "filled", "o_orderpriority", [(k, "binomial", k, {}) for k in links])
    return out.select("o_orderkey", *[f"filled_{k}" for k in links])


def glm_positive_families(spark, d):
    models = [("poisson_log", "poisson", "log", {}), ("poisson_sqrt", "poisson", "sqrt", {}),
              ("gamma_inverse", "gamma", "inverse", {}), ("normal_identity", "normal", "identity", {}),
              ("inversegaussian", "inversegaussian", "inversesquare", {}),
              ("negativebinomial", "poisson", "negativebinomial", {"theta": 50.0})]
    out = _glm_by_level(_t(spark, d, "lineitem"), "l_quantity", "l_returnflag", models)
    return out.select("l_orderkey", "l_linenumber", *[f"l_quantity_{m[0]}" for m in models])


def glm_unseen_level(spark, d):
    # the last priority's orders are validation rows only: its level has no coefficient
    held = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(2)).otherwise(F.lit(1))
    card = GLMCard(target="o_totalprice", formula=(1, "o_orderpriority"), distribution="inversegaussian", link="log",
                   partition="part")
    out = _card_eval(card, _t(spark, d, "orders").withColumn("part", held), "o_orderkey")
    return out.select("o_orderkey", "part", "o_totalprice_hat")


def _documents_labelled(spark, d, target):
    """All documents; the labelled ones are the training rows."""
    docs = _t(spark, d, "documents").select("doc_id", "n_chars", "lang")
    lab = docs.join(_t(spark, d, "labels").select("doc_id", target), "doc_id", "left")
    return lab.withColumn("partition", F.when(F.col(target).isNotNull(), 1).otherwise(2))


def glm_binomial(spark, d):
    card = GLMCard(target="quality", formula=(1, "n_chars", "lang"), distribution="binomial", partition="partition")
    return _card_eval(card, _documents_labelled(spark, d, "quality"), "doc_id").select("doc_id", "quality_hat")


def glm_probit(spark, d):
    card = GLMCard(target="toxic", formula=(1, "n_chars"), distribution="binomial", link="probit", partition="partition")
    return _card_eval(card, _documents_labelled(spark, d, "toxic"), "doc_id").select("doc_id", "toxic_hat")


# ---------------------------------------------------------------------------
# Interpolation (I1-I3, I8): knots = purchase events, evaluated at every event
# ---------------------------------------------------------------------------

def _events_knots(spark, d):
    ev = _t(spark, d, "events")
    return ev.withColumn("partition", F.when(F.col("event_type") == "purchase", 1).otherwise(2))


def _interp(method, **kw):
    def q(spark, d):
        card = InterpCard(input="event_id", targets=("value",), method=method, partition="partition", **kw)
        return _card_eval(card, _events_knots(spark, d), "event_id").select("event_id", "value_hat")
    return q


_KNOTS = "(SELECT event_id AS kx, value AS ky FROM events WHERE event_type = 'purchase')"
INTERP_LINEAR_SQL = f"""
WITH p AS (SELECT event_id, event_id::DOUBLE AS x FROM events),
k AS (SELECT kx::DOUBLE AS kx, ky FROM {_KNOTS}),
lo AS (SELECT p.event_id, p.x, k.kx AS lx, k.ky AS ly FROM p ASOF LEFT JOIN k ON p.x >= k.kx),
hi AS (SELECT p.event_id, k.kx AS hx, k.ky AS hy FROM p ASOF LEFT JOIN (SELECT * FROM k) k ON p.x <= k.kx),
b AS (SELECT lo.*, hi.hx, hi.hy FROM lo JOIN hi USING (event_id))
SELECT event_id, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly WHEN lx = x THEN ly
                      ELSE ly + (hy - ly) * ((x - lx) / (hx - lx)) END AS value_hat FROM b
"""
INTERP_CONSTANT_SQL = f"""
WITH p AS (SELECT event_id, event_id::DOUBLE AS x FROM events),
k AS (SELECT kx::DOUBLE AS kx, ky FROM {_KNOTS}),
lo AS (SELECT p.event_id, k.ky AS ly FROM p ASOF LEFT JOIN k ON p.x >= k.kx),
hi AS (SELECT p.event_id, k.ky AS hy FROM p ASOF LEFT JOIN k ON p.x <= k.kx)
SELECT event_id, coalesce(ly, hy) AS value_hat FROM lo JOIN hi USING (event_id)
"""


def kmeans_lloyd_step(spark, d):
    """One step from fixed centres: the new centres, their weights and their part of the objective."""
    import numpy as np

    from cardinal.operators.cluster import lloyd_step

    cust = _t(spark, d, "customer").select(
        F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("x"), F.lit(1.0).alias("w"))
    sums, sw, obj = lloyd_step(cust, np.array([[0.0, 5.0], [4000.0, 12.0], [8000.0, 20.0]]), Dissimilarity(), cust.rdd.getNumPartitions())
    rows = [(k + 1, float(sums[k, 0] / sw[k]), float(sums[k, 1] / sw[k]), int(sw[k]), float(obj[k])) for k in range(3) if sw[k]]
    return spark.createDataFrame(rows, "cluster int, acctbal double, nation double, n bigint, objective double")


_reg("kmeans_lloyd_step", kmeans_lloyd_step, """
WITH c(k, a, n) AS (VALUES (1, 0.0::DOUBLE, 5.0::DOUBLE), (2, 4000.0, 12.0), (3, 8000.0, 20.0)),
x AS (SELECT c_custkey, c_acctbal, c_nationkey, k, pow(c_acctbal - a, 2) + pow(c_nationkey - n, 2) AS d FROM customer, c),
b AS (SELECT c_custkey, any_value(c_acctbal) AS a, any_value(c_nationkey) AS n, arg_min(k, d) AS k, min(d) AS d FROM x GROUP BY c_custkey)
SELECT k::INTEGER AS cluster, avg(a) AS acctbal, avg(n) AS nation, count(*) AS n, sum(d) AS objective FROM b GROUP BY k""")
_reg("kmeans_fit", kmeans_fit, None)
_reg("dbscan_customer", dbscan_customer, _dbscan_sql(
    "SELECT c_custkey AS id, c_acctbal AS x, c_nationkey AS y FROM customer", "SELECT c_custkey AS id, true AS mine FROM customer",
    "c_custkey", "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", 18.0, 4, 8))
_reg("dbscan_events_cityblock", dbscan_events_cityblock, _dbscan_sql(
    "SELECT event_id AS id, value AS x, hour(ts) * 2.0::DOUBLE AS y FROM events WHERE event_id % 3 = 1",
    "SELECT event_id AS id, event_id % 3 = 1 AS mine FROM events", "event_id", "abs(a.x - b.x) + abs(a.y - b.y)", 1.0, 9, 20))
_reg("kmeans_fit_cityblock_weighted", kmeans_fit_cityblock_weighted, None)
_reg("kmeans_fit_embeddings", kmeans_fit_embeddings, None)
for _name, _dist in _KM_DISTS.items():
    _reg(f"kmeans_assign_{_name}", _kmeans_assign(_dist), _dist_sql(_name))
_reg("pca_2d", _dr("pca"), PCA_SQL)
_reg("mds_2d", _dr("mds"), PCA_SQL)
_reg("ppca_2d", _dr("ppca"), None)
_reg("factor_analysis_2d", _dr("factoranalysis"), None)
_reg("pca_embeddings", pca_embeddings, None)
_reg("lm_simple", lm_simple, LM_SIMPLE_SQL)
_reg("lm_weighted", lm_weighted, LM_WEIGHTED_SQL)
# Own intercept and slope per flag, one slope for tax: tax and price with quantity taken out within each flag.
LM_CATEGORICAL_SQL = """
WITH g AS (
  SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mq, avg(l_tax) AS mt, avg(l_extendedprice) AS my,
         regr_sxx(l_tax, l_quantity) AS qq, regr_sxx(l_quantity, l_tax) AS tt, regr_sxy(l_tax, l_quantity) AS tq,
         regr_sxy(l_extendedprice, l_quantity) AS qy, regr_sxy(l_extendedprice, l_tax) AS ty
  FROM lineitem GROUP BY l_returnflag
), t AS (
  SELECT sum(ty - tq * qy / qq) / sum(tt - tq * tq / qq) AS bt FROM g
), c AS (
  SELECT l_returnflag, bt, (qy - bt * tq) / qq AS bq, my - (qy - bt * tq) / qq * mq - bt * mt AS b0 FROM g JOIN t ON true
)
SELECT l_orderkey, l_linenumber, b0 + bq * l_quantity + bt * l_tax AS l_extendedprice_hat FROM lineitem JOIN c USING (l_returnflag)
"""
_reg("lm_categorical", lm_categorical, LM_CATEGORICAL_SQL)
_reg("glm_poisson", glm_poisson, None)
# With one categorical term the fitted values are the groups' weighted means, whatever the link.
_reg("glm_gamma_weighted", glm_gamma_weighted, """
SELECT o_orderkey, sum(o_custkey * o_totalprice) OVER w / sum(o_custkey) OVER w AS o_totalprice_hat
FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
_reg("glm_binomial_links", glm_binomial_links, """
SELECT o_orderkey, p AS filled_logit, p AS filled_probit, p AS filled_cloglog, p AS filled_cauchit
FROM (SELECT o_orderkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY o_orderpriority) AS p
      FROM orders) t""")
_reg("glm_positive_families", glm_positive_families, """
SELECT l_orderkey, l_linenumber, m AS l_quantity_poisson_log, m AS l_quantity_poisson_sqrt, m AS l_quantity_gamma_inverse,
       m AS l_quantity_normal_identity, m AS l_quantity_inversegaussian, m AS l_quantity_negativebinomial
FROM (SELECT l_orderkey, l_linenumber, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) t""")
_reg("glm_unseen_level", glm_unseen_level, """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 1 END AS part,
       CASE WHEN o_orderpriority <> '5-LOW' THEN avg(o_totalprice) OVER (PARTITION BY o_orderpriority) END AS o_totalprice_hat
FROM orders""")
_reg("glm_binomial", glm_binomial, None)
_reg("glm_probit", glm_probit, None)
_reg("interp_linear", _interp("linear", extrapolation_left="constant", extrapolation_right="constant"),
     INTERP_LINEAR_SQL)
_reg("interp_constant", _interp("constant", extrapolation_left="constant", extrapolation_right="constant"),
     INTERP_CONSTANT_SQL)
# Knots with two neighbours on each side, and every event between its brackets.
_BRACKETS = """
WITH k AS (
  SELECT event_id::DOUBLE AS x, value AS y, lag(event_id::DOUBLE) OVER w AS xa, lag(value) OVER w AS ya,
         lag(event_id::DOUBLE, 2) OVER w AS xb, lag(value, 2) OVER w AS yb, lead(event_id::DOUBLE) OVER w AS xc,
         lead(value) OVER w AS yc, lead(event_id::DOUBLE, 2) OVER w AS xd, lead(value, 2) OVER w AS yd
  FROM events WHERE event_type = 'purchase' WINDOW w AS (ORDER BY event_id)
), s AS (
  SELECT *, (ya - yb) / (xa - xb) AS sb, (y - ya) / (x - xa) AS sa, (yc - y) / (xc - x) AS sc, (yd - yc) / (xd - xc) AS sd FROM k
), e AS (
  SELECT *, {slope} AS m FROM s
), p AS (
  SELECT event_id, event_id::DOUBLE AS q FROM events
), b AS (
  SELECT p.event_id, p.q, l.x AS lx, l.y AS ly, l.xa AS lxa, l.ya AS lya, l.m AS lm,
         h.x AS hx, h.y AS hy, h.xc AS hxc, h.yc AS hyc, h.m AS hm
  FROM p ASOF LEFT JOIN e l ON p.q >= l.x ASOF LEFT JOIN e h ON p.q <= h.x
)
SELECT event_id, CASE WHEN lx IS NULL THEN {left} WHEN lx = q THEN ly WHEN hx IS NULL THEN {right} ELSE {inside} END AS value_hat
FROM b
"""
_HERMITE = ("(2*pow((q-lx)/(hx-lx),3) - 3*pow((q-lx)/(hx-lx),2) + 1) * ly"
            " + (pow((q-lx)/(hx-lx),3) - 2*pow((q-lx)/(hx-lx),2) + (q-lx)/(hx-lx)) * (hx-lx) * lm"
            " + (-2*pow((q-lx)/(hx-lx),3) + 3*pow((q-lx)/(hx-lx),2)) * hy"
            " + (pow((q-lx)/(hx-lx),3) - pow((q-lx)/(hx-lx),2)) * (hx-lx) * hm")


def _parabola(*points):
    terms = []
    for i, (x, y) in enumerate(points):
        (u, _), (v, _) = (pt for j, pt in enumerate(points) if j != i)
        terms.append(f"{y} * ((q - {u}) * (q - {v})) / (({x} - {u}) * ({x} - {v}))")
    return " + ".join(terms)


_QUADRATIC_SQL = _BRACKETS.format(
    slope="NULL::DOUBLE", left="hy + (hyc - hy) * (q - hx) / (hxc - hx)", right="lya + (ly - lya) * (q - lxa) / (lx - lxa)",
    inside=f"CASE WHEN hxc IS NOT NULL THEN {_parabola(('lx', 'ly'), ('hx', 'hy'), ('hxc', 'hyc'))} "
           f"ELSE {_parabola(('lxa', 'lya'), ('lx', 'ly'), ('hx', 'hy'))} END")


def _pchip_end(h0, h1, d0, d1):
    t = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"CASE WHEN sign({t}) <> sign({d0}) THEN 0.0 WHEN sign({d0}) <> sign({d1}) AND abs({t}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {t} END"


_PCHIP_SQL = _BRACKETS.format(
    slope=f"CASE WHEN xa IS NULL THEN {_pchip_end('(xc - x)', '(xd - xc)', 'sc', 'sd')} "
          f"WHEN xc IS NULL THEN {_pchip_end('(x - xa)', '(xa - xb)', 'sa', 'sb')} WHEN sa * sc <= 0 THEN 0.0 "
          "ELSE (2*(xc-x) + (x-xa) + (xc-x) + 2*(x-xa)) / ((2*(xc-x) + (x-xa)) / sa + ((xc-x) + 2*(x-xa)) / sc) END",
    left="hy", right="ly", inside=_HERMITE)
_A = "coalesce(sa, 2*sc - sd)"
_B = "coalesce(sb, CASE WHEN sa IS NULL THEN 3*sc - 2*sd ELSE 2*sa - sc END)"
_C = "coalesce(sc, 2*sa - sb)"
_D = "coalesce(sd, CASE WHEN sc IS NULL THEN 3*sa - 2*sb ELSE 2*sc - sa END)"
_AKIMA_SQL = _BRACKETS.format(
    slope=f"CASE WHEN abs({_D} - {_C}) + abs({_A} - {_B}) = 0 THEN ({_A} + {_C}) / 2 ELSE (abs({_D} - {_C}) * {_A} + "
          f"abs({_A} - {_B}) * {_C}) / (abs({_D} - {_C}) + abs({_A} - {_B})) END",
    left="hy + (q - hx) * hm", right="ly + (q - lx) * lm", inside=_HERMITE)

_reg("interp_quadratic", _interp("quadratic", extrapolation_left="linear", extrapolation_right="linear"), _QUADRATIC_SQL)
_reg("interp_pchip", _interp("pchip", extrapolation_left="constant", extrapolation_right="constant"), _PCHIP_SQL)
_reg("interp_akima", _interp("akima", extrapolation_left="extension", extrapolation_right="extension"), _AKIMA_SQL)


def _orders_knots(rule):
    """Knots: the orders in the middle two thirds of the key range; the others lie beyond on both sides."""
    def q(spark, d):
        orders = _t(spark, d, "orders")
        n = orders.agg(F.max("o_orderkey")).first()[0]
        part = F.when(F.col("o_orderkey").between(n // 6, 5 * n // 6), 1).otherwise(2)
        card = InterpCard(input="o_orderkey", targets=("o_totalprice",), method="linear", partition="partition",
                          extrapolation_left=rule, extrapolation_right=rule)
        return _card_eval(card, orders.withColumn("partition", part), "o_orderkey").select("o_orderkey", "o_totalprice_hat")
    return q


_FOLDED_SQL = """
WITH n AS (SELECT max(o_orderkey) // 6 AS a, 5 * max(o_orderkey) // 6 AS z FROM orders),
k AS (SELECT o_orderkey::DOUBLE AS x, o_totalprice AS y FROM orders, n WHERE o_orderkey BETWEEN a AND z),
m AS (SELECT min(x) AS lo, max(x) AS hi, max(x) - min(x) AS span FROM k),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN lo AND hi THEN o_orderkey::DOUBLE ELSE {fold} END AS q FROM orders, m),
b AS (SELECT p.*, l.x AS lx, l.y AS ly, h.x AS hx, h.y AS hy
      FROM p ASOF LEFT JOIN k l ON p.q >= l.x ASOF LEFT JOIN k h ON p.q <= h.x)
SELECT o_orderkey, CASE WHEN lx = q THEN ly ELSE ly + (hy - ly) * ((q - lx) / (hx - lx)) END AS o_totalprice_hat FROM b
"""
_reg("interp_periodic", _orders_knots("periodic"),
     _FOLDED_SQL.format(fold="lo + ((o_orderkey - lo) - span * floor((o_orderkey - lo) / span))"))
_reg("interp_reflective", _orders_knots("reflective"),
     _FOLDED_SQL.format(fold="lo + span - abs(((o_orderkey - lo) - 2 * span * floor((o_orderkey - lo) / (2 * span))) - span)"))
# Spline knots in order, with the recurrences of their slopes or curvatures.
_SPLINE = """
WITH RECURSIVE k AS (
  SELECT row_number() OVER (ORDER BY event_id) AS r, event_id::DOUBLE AS x, value AS y FROM events WHERE event_type = 'purchase'
), g AS (
  SELECT r, x, y, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xc, lead(y) OVER w AS yc FROM k WINDOW w AS (ORDER BY r)
), {recurrence}, p AS (
  SELECT event_id, event_id::DOUBLE AS q FROM events
), b AS (
  SELECT p.event_id, p.q, l.x AS lx, l.y AS ly, l.m AS lm, l.xa AS lxa, l.ya AS lya, l.ma AS lma,
         h.x AS hx, h.y AS hy, h.m AS hm, h.xc AS hxc, h.yc AS hyc, h.mc AS hmc
  FROM p ASOF LEFT JOIN e l ON p.q >= l.x ASOF LEFT JOIN e h ON p.q <= h.x
)
SELECT event_id, CASE WHEN lx IS NULL THEN {left} WHEN lx = q THEN ly WHEN hx IS NULL THEN {right} ELSE {inside} END AS value_hat
FROM b
"""
_AROUND = ("e AS (SELECT g.*, m, lag(m) OVER w AS ma, lead(m) OVER w AS mc FROM g JOIN {s} USING (r) WINDOW w AS (ORDER BY g.r))")
_QUADSPLINE_SQL = _SPLINE.format(
    recurrence="z AS (SELECT 1::BIGINT AS r, 0.0::DOUBLE AS m UNION ALL SELECT z.r + 1, 2 * (g.yc - g.y) / (g.xc - g.x) - z.m "
               "FROM z JOIN g ON g.r = z.r WHERE g.xc IS NOT NULL), " + _AROUND.format(s="z"),
    left="hy", right="ly", inside="ly + lm * (q - lx) + ((hy - ly) / (hx - lx) - lm) * (q - lx) * (q - lx) / (hx - lx)")
_CUBIC_SQL = _SPLINE.format(
    recurrence="""t AS (
  SELECT r, x - xa AS a, 2 * (xc - xa) AS d, xc - x AS c, 6 * ((yc - y) / (xc - x) - (y - ya) / (x - xa)) AS v
  FROM g WHERE xa IS NOT NULL AND xc IS NOT NULL
), f AS (
  SELECT 1::BIGINT AS r, 0.0::DOUBLE AS cp, 0.0::DOUBLE AS dp
  UNION ALL SELECT t.r, t.c / (t.d - t.a * f.cp), (t.v - t.a * f.dp) / (t.d - t.a * f.cp) FROM f JOIN t ON t.r = f.r + 1
), u AS (
  SELECT (SELECT max(r) FROM k) AS r, 0.0::DOUBLE AS m
  UNION ALL SELECT f.r, CASE WHEN f.r = 1 THEN 0.0 ELSE f.dp - f.cp * u.m END FROM u JOIN f ON f.r = u.r - 1
), """ + _AROUND.format(s="u"),
    left="hy + (q - hx) * ((hyc - hy) / (hxc - hx) - (hxc - hx) * hmc / 6)",
    right="ly + (q - lx) * ((ly - lya) / (lx - lxa) + (lx - lxa) * lma / 6)",
    inside="lm * pow(hx - q, 3) / (6 * (hx - lx)) + hm * pow(q - lx, 3) / (6 * (hx - lx)) + (ly / (hx - lx) - lm * (hx - lx) / 6) * (hx - q)"
           " + (hy / (hx - lx) - hm * (hx - lx) / 6) * (q - lx)")
_reg("interp_quadraticspline", _interp("quadraticspline", extrapolation_left="constant",
                                      extrapolation_right="constant"), _QUADSPLINE_SQL)
_reg("interp_cubicspline", _interp("cubicspline", extrapolation_left="extension", extrapolation_right="extension"),
     _CUBIC_SQL)


# ---------------------------------------------------------------------------
# Metrics (N11, N12), one-hot (N2, N3), batches
# ---------------------------------------------------------------------------

from cardinal.functions import metrics as M  # noqa: E402
from cardinal.operators import funnel  # noqa: E402


def _metric_frame(spark, d):
    li = _t(spark, d, "lineitem")
    a1, a2, a3 = F.col("l_discount") + 0.01, F.col("l_tax") + 0.01, F.col("l_quantity") / 500.0
    s = a1 + a2 + a3
    return li.select(
        (F.col("l_tax") * 10).alias("p"), (F.col("l_discount") * 10).alias("y"),
        (F.col("l_tax") * 10 - 0.5).alias("z"), F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0).alias("s"),
        (a1 / s).alias("p1"), (a2 / s).alias("p2"), (a3 / s).alias("p3"),
        *[F.when(F.col("l_returnflag") == f, 1.0).otherwise(0.0).alias(f"y{i + 1}") for i, f in enumerate("ANR")],
        F.col("l_orderkey"),
    )


REGRESSION_METRICS = ("mae", "mse", "msle", "huber_loss", "binarycrossentropy", "poisson_loss",
                      "binary_focal_loss", "siamese_contrastive_loss")


def metrics_regression(spark, d):
    return M.evaluate_metrics(_metric_frame(spark, d), ["p"], ["y"], REGRESSION_METRICS)


def metrics_margin(spark, d):
    m = _metric_frame(spark, d)
    return M.evaluate_metrics(m, ["z"], ["s"], ("hinge_loss", "squared_hinge_loss", "logitbinarycrossentropy"),
                              agg="sum")


def metrics_classification(spark, d):
    m = _metric_frame(spark, d)
    return M.evaluate_metrics(m, ["p1", "p2", "p3"], ["y1", "y2", "y3"],
                              ("accuracy", "crossentropy", "logitcrossentropy", "kldivergence", "focal_loss"))


def metrics_batch_mean(spark, d):
    m = _metric_frame(spark, d).withColumn("b", F.col("l_orderkey") % 7)
    return M.evaluate_metrics(m, ["p"], ["y"], ("mse", "mae"), batch="b")


_E = "1.1920929e-07"
_MF = """WITH m AS (SELECT l_tax * 10 AS p, l_discount * 10 AS y, l_tax * 10 - 0.5 AS z,
  CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -1.0 END AS s,
  (l_discount + 0.01) / ((l_discount + 0.01) + (l_tax + 0.01) + l_quantity / 500.0) AS p1,
  (l_tax + 0.01) / ((l_discount + 0.01) + (l_tax + 0.01) + l_quantity / 500.0) AS p2,
  (l_quantity / 500.0) / ((l_discount + 0.01) + (l_tax + 0.01) + l_quantity / 500.0) AS p3,
  CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS y1,
  CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS y2,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y3, l_orderkey FROM lineitem)"""


def _xlogy_sql(x, y):
    return f"(CASE WHEN ({x}) = 0 THEN 0.0 ELSE ({x}) * ln({y}) END)"


METRICS_REGRESSION_SQL = _MF + f"""
SELECT avg(abs(p - y)) AS mae, avg((p - y) * (p - y)) AS mse,
  avg(pow(ln((p + {_E}) / (y + {_E})), 2)) AS msle,
  avg(CASE WHEN abs(p - y) < 1.0 THEN 0.5 * abs(p - y) * abs(p - y) ELSE 1.0 * (abs(p - y) - 0.5) END) AS huber_loss,
  avg(-{_xlogy_sql('y', f'p + {_E}')} - {_xlogy_sql('1 - y', f'1 - p + {_E}')}) AS binarycrossentropy,
  avg(p - {_xlogy_sql('y', 'p')}) AS poisson_loss,
  avg(pow(1 - (y * (p + {_E}) + (1 - y) * (1 - (p + {_E}))), 2.0)
      * -ln(y * (p + {_E}) + (1 - y) * (1 - (p + {_E})))) AS binary_focal_loss,
  avg((1 - y) * p * p + y * pow(greatest(0.0, 1.0 - p), 2)) AS siamese_contrastive_loss
FROM m"""

METRICS_MARGIN_SQL = _MF + """
SELECT sum(greatest(0.0, 1 - z * s)) AS hinge_loss, sum(pow(greatest(0.0, 1 - z * s), 2)) AS squared_hinge_loss,
  sum((1 - s) * z + (greatest(-z, 0.0) + ln(1 + exp(-abs(z))))) AS logitbinarycrossentropy
FROM m"""

_LSE = "(greatest(p1, p2, p3) + ln(exp(p1 - greatest(p1, p2, p3)) + exp(p2 - greatest(p1, p2, p3)) + exp(p3 - greatest(p1, p2, p3))))"
METRICS_CLASSIFICATION_SQL = _MF + f"""
SELECT avg(CASE WHEN (CASE WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END)
               = (CASE WHEN y1 >= y2 AND y1 >= y3 THEN 1 WHEN y2 >= y3 THEN 2 ELSE 3 END) THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(-({_xlogy_sql('y1', f'p1 + {_E}')} + {_xlogy_sql('y2', f'p2 + {_E}')} + {_xlogy_sql('y3', f'p3 + {_E}')})) AS crossentropy,
  avg(-(y1 * (p1 - {_LSE}) + y2 * (p2 - {_LSE}) + y3 * (p3 - {_LSE}))) AS logitcrossentropy,
  avg(({_xlogy_sql('y1', 'y1')} + {_xlogy_sql('y2', 'y2')} + {_xlogy_sql('y3', 'y3')})
      - ({_xlogy_sql('y1', f'p1 + {_E}')} + {_xlogy_sql('y2', f'p2 + {_E}')} + {_xlogy_sql('y3', f'p3 + {_E}')})) AS kldivergence,
  avg(-y1 * pow(1 - (p1 + {_E}), 2.0) * ln(p1 + {_E}) - y2 * pow(1 - (p2 + {_E}), 2.0) * ln(p2 + {_E})
      - y3 * pow(1 - (p3 + {_E}), 2.0) * ln(p3 + {_E})) AS focal_loss
FROM m"""

METRICS_BATCH_SQL = _MF + """
SELECT avg(mse) AS mse, avg(mae) AS mae FROM (
  SELECT l_orderkey % 7 AS b, avg((p - y) * (p - y)) AS mse, avg(abs(p - y)) AS mae FROM m GROUP BY 1)"""


def onehot_events(spark, d):
    ev = _t(spark, d, "events")
    lv = funnel.levels(ev, "event_type")
    return funnel.onehot(ev, "event_type", lv).select("event_id", *funnel.onehot_names("event_type", lv))


ONEHOT_SQL = ("SELECT event_id, " + ", ".join(
    f"CASE WHEN event_type = '{lv}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_{lv}"
    for lv in ("click", "error", "purchase", "signup", "view")) + " FROM events")


def onehot_roundtrip(spark, d):
    ev = _t(spark, d, "events")
    lv = funnel.levels(ev, "event_type")
    names = funnel.onehot_names("event_type", lv)
    enc = funnel.onehot(ev, "event_type", lv)
    return enc.select("event_id", funnel.onehot_decode([F.col(n) for n in names], lv).alias("decoded"))


def batch_stats(spark, d):
    ev = _t(spark, d, "events")
    b = funnel.with_batches(ev, ["ts", "event_id"], 32, tiebreak=["event_id"])
    return b.groupBy(F.col(funnel.BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


BATCH_SQL = """SELECT batch, count(*) AS n, sum(value) AS total FROM (
  SELECT value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 32 AS batch FROM events)
GROUP BY batch"""


_reg("metrics_regression", metrics_regression, METRICS_REGRESSION_SQL)
_reg("metrics_margin", metrics_margin, METRICS_MARGIN_SQL)
_reg("metrics_classification", metrics_classification, METRICS_CLASSIFICATION_SQL)
_reg("metrics_batch_mean", metrics_batch_mean, METRICS_BATCH_SQL)


def _pinball(p, y):
    """A user's metric: the loss of the 90 % quantile."""
    over = [F.greatest(0.9 * (b - a), 0.1 * (a - b)) for a, b in zip(p, y)]
    return sum(over[1:], over[0]), len(over)


M.register_metric("pinball_90", _pinball)


def metrics_registered(spark, d):
    return M.evaluate_metrics(_metric_frame(spark, d), ["p", "p1"], ["y", "p2"], ["pinball_90", "mae"])


_reg("metrics_registered", metrics_registered, _MF + """
SELECT avg((greatest(0.9 * (y - p), 0.1 * (p - y)) + greatest(0.9 * (p2 - p1), 0.1 * (p1 - p2))) / 2) AS pinball_90,
       avg((abs(p - y) + abs(p1 - p2)) / 2) AS mae FROM m""")


def _vae_frame(spark, d):
    """An autoencoder's columns: reconstructions r1, r2 of x1, x2 and a latent normal with two dimensions."""
    li = _t(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 16).alias("batch"), (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"),
                     (F.col("l_quantity") / 55 + 0.02).alias("r1"), (F.col("l_discount") * 9 + 0.05).alias("r2"),
                     (F.col("l_tax") * 10 - 0.4).alias("m1"), (F.col("l_discount") - F.col("l_tax")).alias("m2"),
                     (F.col("l_tax") * -20).alias("v1"), (F.col("l_discount") * 5 - 0.3).alias("v2"))


_VAE = (["r1", "r2"], ["x1", "x2"], ["m1", "m2"], ["v1", "v2"])


def metrics_vae(spark, d):
    whole = _vae_frame(spark, d)
    parts = [("mean", 0.5, None), ("sum", 1.0, None), ("mean", 2.0, "batch")]
    out = None
    for agg, beta, batch in parts:
        row = M.evaluate_vae_loss(whole, *_VAE, agg=agg, beta=beta, batch=batch).select(
            F.lit(f"{agg} {beta} {batch or 'all'}").alias("how"), "vae_loss")
        out = row if out is None else out.union(row)
    return out


_reg("metrics_vae", metrics_vae, """
WITH t AS (
  SELECT l_orderkey % 16 AS batch, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_quantity / 55 + 0.02 AS r1, l_discount * 9 + 0.05 AS r2,
         l_tax * 10 - 0.4 AS m1, l_discount - l_tax AS m2, l_tax * -20 AS v1, l_discount * 5 - 0.3 AS v2 FROM lineitem
), e AS (
  SELECT batch, (r1 - x1) ** 2 + (r2 - x2) ** 2 AS sq, (exp(v1) + m1 ** 2 - 1 - v1 + exp(v2) + m2 ** 2 - 1 - v2) / 2 AS dv FROM t
)
SELECT 'mean 0.5 all' AS how, avg(sq) / 2 + 0.5 * avg(dv) AS vae_loss FROM e
UNION ALL SELECT 'sum 1.0 all', sum(sq) + sum(dv) FROM e
UNION ALL SELECT 'mean 2.0 batch', avg(l) FROM (SELECT avg(sq) / 2 + 2 * avg(dv) AS l FROM e GROUP BY batch)""")
_reg("onehot_events", onehot_events, ONEHOT_SQL)
_reg("onehot_roundtrip", onehot_roundtrip, "SELECT event_id, event_type AS decoded FROM events")
_reg("batch_stats", batch_stats, BATCH_SQL)


# ---------------------------------------------------------------------------
# Dense network card (N1-N21): split, then data-parallel training
# ---------------------------------------------------------------------------

from cardinal.operators.nn import DenseNetCard, Training  # noqa: E402


def _nn(targets, layers, epochs=4):
    def q(spark, d):
        li = _t(spark, d, "lineitem").withColumn("rid", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
        split = SplitCard(PercentileMethod(0.8), order_by=("rid",))
        net = DenseNetCard(inputs=("l_discount", "l_tax"), targets=targets, order_by=("rid",), layers=layers,
                           training=Training(optimizer="adam", eta=1e-2, epochs=epochs, batches=4, seed=1),
                           partition="partition")
        out = CardGraph([Node(split), Node(net)]).train_evaljoin(li, "rid")
        return out.select("l_orderkey", "l_linenumber", "partition", *net.outputs())
    return q


# A network with given weights: prediction and validation are plain arithmetic.
_NN_WEIGHTS = [[[0.5, -1.0], [2.0, 0.25]], [0.1, -0.2], [[1.5], [-0.75]], [0.3]]


def _fixed_net():
    from cardinal.plans.card import CardState

    card = DenseNetCard(inputs=("l_discount", "l_tax"), targets=("l_quantity",), order_by=("l_orderkey",),
                        layers=({"features": 2, "sigma": "relu"}, {"sigma": "identity"}),
                        training=Training(metrics=("mae", "huber_loss")))
    return card, CardState(content={"params": _NN_WEIGHTS, "acts": ["relu", "identity"], "levels": {}})


def nn_predict(spark, d):
    card, state = _fixed_net()
    return card.transform(_t(spark, d, "lineitem"), state).select("l_orderkey", "l_linenumber", "l_quantity_hat")


def nn_validate(spark, d):
    card, state = _fixed_net()
    got = card.validate(_t(spark, d, "lineitem"), state, split=1)
    return spark.createDataFrame([(got["loss"], got["mae"], got["huber_loss"])], "loss double, mae double, huber_loss double")


_NN_HAT = ("0.3 + 1.5 * greatest(0.1 + l_discount * 0.5 + l_tax * 2.0, 0) - 0.75 * greatest(-0.2 - l_discount + l_tax * 0.25, 0)")
_reg("nn_predict", nn_predict, f"SELECT l_orderkey, l_linenumber, {_NN_HAT} AS l_quantity_hat FROM lineitem")
_reg("nn_validate", nn_validate, f"""
WITH e AS (SELECT abs(({_NN_HAT}) - l_quantity) AS e FROM lineitem)
SELECT avg(e * e) AS loss, avg(e) AS mae, avg(CASE WHEN e < 1 THEN 0.5 * e * e ELSE e - 0.5 END) AS huber_loss FROM e""")
_reg("nn_regression", _nn(("l_quantity",), ({"features": 5, "sigma": "relu"}, {"sigma": "identity"})), None)
_reg("nn_classifier", _nn(("l_returnflag",), ({"features": 8, "sigma": "tanh"}, {"sigma": "identity"})), None)


# ---------------------------------------------------------------------------
# Streaming scoring with frozen nodes
# ---------------------------------------------------------------------------

from cardinal.streaming.scoring import read_stream, score_to_table  # noqa: E402


def stream_score(spark, d):
    import uuid

    ev = _t(spark, d, "events")
    nodes = [Node(RescaleCard("zscore", inputs=("value",), group_by=("event_type",))),
             Node(GaussianEncodingCard(input="ts", n_components=4, method="hourofday"))]
    for n in nodes:
        n.fit(ev, "event_id")
    stream = read_stream(spark, d, ev.schema, glob="events.parquet")
    out = score_to_table(stream, nodes, f"stream_score_{uuid.uuid4().hex[:8]}", "event_id")
    return out.select("event_id", "value_rescaled", *[f"ts_gaussian_{i}" for i in range(1, 5)])


def _stream_sql():
    g = _gauss_sql("hour(ts)", 4, 24.0, "ts").replace("SELECT event_id, ", "").replace(" FROM events", "")
    return ("SELECT e.event_id, (e.value - s.m) / s.sd AS value_rescaled, " + g.replace("ts", "e.ts").replace(
        "e.e.ts", "e.ts").replace("e.ts_gaussian", "ts_gaussian") + " FROM events e LEFT JOIN "
        "(SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type) s "
        "ON e.event_type = s.event_type")


_reg("stream_score", stream_score, _stream_sql())


def _least_squares_net(spark, d, optimizer):
    """A network without hidden layers: its optimum is the least-squares plane, whatever the way there."""
    li = _t(spark, d, "lineitem").withColumns({
        "price": F.col("l_extendedprice") / 10000, "amount": F.col("l_quantity") / 50, "cut": F.col("l_discount") * 10})
    card = DenseNetCard(inputs=("amount", "cut"), targets=("price",), order_by=("l_orderkey",), layers=({"sigma": "identity"},),
                           training=Training(optimizer=optimizer, epochs=60, seed=5, g_tol=1e-11))
    state = card.fit(li)
    out = card.transform(li, state).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("price_hat", 3).alias("price_hat"))
    return out.distinct()


def nn_lbfgs_plane(spark, d):
    return _least_squares_net(spark, d, "lbfgs")


def nn_bfgs_plane(spark, d):
    return _least_squares_net(spark, d, "bfgs")


_PLANE_SQL = """
WITH x AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 10000 AS y, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem
), s AS (
  SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
         covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM x
), w AS (
  SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s
)
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(my + wa * (a - ma) + wb * (b - mb), 3) AS price_hat FROM x, w"""
_reg("nn_lbfgs_plane", nn_lbfgs_plane, _PLANE_SQL)
_reg("nn_bfgs_plane", nn_bfgs_plane, _PLANE_SQL)


# A network whose features lie in a second table (N21): the least-squares plane over the joined rows.
from cardinal.operators.funnels import LookupFunnel  # noqa: E402


def nn_funnel_two_tables(spark, d):
    orders = _t(spark, d, "orders").withColumns({"amount": F.col("o_totalprice") / 100000})
    customer = _t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("balance"),
                                               (F.col("c_nationkey") / 25).alias("nation"))
    funnel = LookupFunnel(on=(("o_custkey", "c_custkey"),), columns=("balance", "nation"), targets=("amount",), order_by=("o_orderkey",))
    card = DenseNetCard(funnel=funnel, layers=({"sigma": "identity"},),
                        training=Training(optimizer="lbfgs", epochs=60, seed=3, g_tol=1e-11)).with_helpers({"lookup": customer})
    out = _card_eval(card, orders, "o_orderkey")
    return out.select("o_orderkey", "o_custkey", F.round("amount_hat", 3).alias("amount_hat"))


_reg("nn_funnel_two_tables", nn_funnel_two_tables, """
WITH x AS (
  SELECT o_orderkey, o_custkey, o_totalprice / 100000 AS y, c_acctbal / 5000 AS a, c_nationkey / 25 AS b
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), s AS (
  SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
         covar_pop(a, y) AS ay, covar_pop(b, y) AS byy FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL
), w AS (
  SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s
)
SELECT o_orderkey, o_custkey, round(my + wa * (a - ma) + wb * (b - mb), 3) AS amount_hat FROM x, w""")


def nn_logsumexp_predict(spark, d):
    from cardinal.plans.card import CardState

    card = DenseNetCard(inputs=("l_discount", "l_tax"), targets=("l_quantity",), order_by=("l_orderkey",),
                        layers=({"features": 3, "sigma": "logsumexp"},))
    state = CardState(content={"params": [[[4.0, -6.0, 0.5], [9.0, 3.0, -7.0]], [1.0, 2.0, 0.25]], "acts": ["logsumexp"], "levels": {}})
    return card.transform(_t(spark, d, "lineitem"), state).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_hat")


_reg("nn_logsumexp_predict", nn_logsumexp_predict, """
SELECT l_orderkey, l_linenumber, l_partkey, ln(exp(1 + 4 * l_discount + 9 * l_tax) + exp(2 - 6 * l_discount + 3 * l_tax)
  + exp(0.25 + 0.5 * l_discount - 7 * l_tax)) AS l_quantity_hat FROM lineitem""")


# ---------------------------------------------------------------------------
# User-defined card (U1), SQL macros (S23), min-by-group dedup
# ---------------------------------------------------------------------------

from cardinal.operators.wild import WildCard, register_wild_card  # noqa: E402
from cardinal.sources.tables import execute_with_macros  # noqa: E402


def _median_fit(df):
    # a small model: the exact median of each segment
    rows = df.groupBy("c_mktsegment").agg(F.percentile("c_acctbal", 0.5).alias("m")).collect()
    return {r["c_mktsegment"]: r["m"] for r in rows}


def _median_transform(df, model, id_var):
    m = F.create_map(*[x for k, v in sorted(model.items()) for x in (F.lit(k), F.lit(float(v)))])
    return df.select(id_var, (F.col("c_acctbal") - m[F.col("c_mktsegment")]).alias("c_acctbal_centred"))


register_wild_card("median_centre", "Median centring", _median_fit, _median_transform)


def wild_median_centre(spark, d):
    card = WildCard("median_centre", inputs=("c_acctbal", "c_mktsegment"), outputs=("c_acctbal_centred",))
    return _card_eval(card, _t(spark, d, "customer"), "c_custkey").select("c_custkey", "c_acctbal_centred")


WILD_SQL = """SELECT c.c_custkey, c.c_acctbal - m.m AS c_acctbal_centred FROM customer c JOIN
  (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY c_mktsegment) m
  ON c.c_mktsegment = m.c_mktsegment"""


def macro_revenue(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    macros = ["disc_price(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)",
              "charge(p DOUBLE, d DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN p * (1 - d) * (1 + t)"]
    sql = ("SELECT l_returnflag, l_linestatus, sum(disc_price(l_extendedprice, l_discount)) AS revenue, "
           "sum(charge(l_extendedprice, l_discount, l_tax)) AS charge FROM lineitem GROUP BY l_returnflag, l_linestatus")
    return execute_with_macros(spark, macros, sql)


MACRO_SQL = """SELECT l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) AS revenue,
  sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge FROM lineitem GROUP BY l_returnflag, l_linestatus"""


def row_id_file_order(spark, d):
    """Ids in file order; the filter comes after the numbering and still reaches the scan."""
    li = ranking.add_row_id(_t(spark, d, "lineitem"), "_id")
    return li.where("l_quantity > 25").select("_id", "l_orderkey", "l_linenumber", "l_partkey")


def summary_events(spark, d):
    from cardinal.operators.summary import summary_table

    return summary_table(_t(spark, d, "events")).drop("column_no")


def page_deep(spark, d):
    """The page at nine tenths of lineitem."""
    from cardinal.plans.dashboard import PageIndex

    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    order = [{"colId": "l_shipdate", "sort": "desc"}] + [{"colId": c} for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    index = PageIndex(li, order, slice_rows=5000)
    return index.page(200, index.total * 9 // 10)


def batch_shuffled(spark, d):
    """Which batch of 32 every event is in, in two epochs."""
    ev = _t(spark, d, "events").select("event_id", "value")
    one = funnel.shuffled_batches(ev, ["event_id"], 32, seed=11, epoch=1).withColumnRenamed(funnel.BATCH, "first")
    two = funnel.shuffled_batches(ev.select("event_id"), ["event_id"], 32, seed=11, epoch=2).withColumnRenamed(funnel.BATCH, "second")
    return one.join(two, "event_id")


def _shuffled_sql(epoch):
    key = f"('0x' || substr(md5('11:{epoch}:' || event_id), 1, 15))::BIGINT"
    return f"(row_number() OVER (ORDER BY {key}, event_id) - 1) // 32"


_EVENT_TEXTS = (("ts", "datetime", "strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.')", "ts"),
                ("event_type", "string", "event_type", "event_type"), ("props", "string", "props", "props"))
_reg("row_id_file_order", row_id_file_order, """SELECT _id, l_orderkey, l_linenumber, l_partkey FROM (
  SELECT row_number() OVER () AS _id, * FROM lineitem) WHERE l_quantity > 25""")
_reg("summary_events", summary_events, " UNION ALL ".join(
    [f"""SELECT '{c}' AS name, 'numerical' AS kind, '{k}' AS eltype, NULL::BIGINT AS position, NULL::VARCHAR AS value,
  min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM events""" for c, k in (("event_id", "int"), ("user_id", "int"), ("value", "float"))]
    + [f"""SELECT '{c}', 'categorical', '{k}', row_number() OVER (ORDER BY o NULLS LAST), v, NULL, NULL
  FROM (SELECT DISTINCT {e} AS v, {o} AS o FROM events)""" for c, k, e, o in _EVENT_TEXTS]))
_reg("page_deep", page_deep, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
  ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200 OFFSET (SELECT count(*) * 9 // 10 FROM lineitem)""")
_reg("batch_shuffled", batch_shuffled, f"SELECT event_id, value, {_shuffled_sql(1)} AS first, {_shuffled_sql(2)} AS second FROM events")


def process_flow_file_order(spark, d):
    """The process flow with rows numbered as the file holds them."""
    cards = [SplitCard(PercentileMethod(0.8), order_by=("o_orderdate",), group_by=("o_orderpriority",)),
             RescaleCard("minmax", inputs=("o_totalprice",), partition="partition")]
    out = process(_t(spark, d, "orders"), [ListFilter("o_orderstatus", ("F", "O"))], cards)
    return out.select("_id", "o_orderkey", "partition", "o_totalprice_rescaled")


def dedup_min_id(spark, d):
    o = _t(spark, d, "orders")
    return o.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))


_reg("wild_median_centre", wild_median_centre, WILD_SQL)
_reg("macro_revenue", macro_revenue, MACRO_SQL)
_reg("dedup_min_id", dedup_min_id,
     "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus")


# ---------------------------------------------------------------------------
# Linear mixed model
# ---------------------------------------------------------------------------

from cardinal.operators.mixed import MixedModelCard  # noqa: E402


def mixed_random_intercept(spark, d):
    card = MixedModelCard(target="l_extendedprice", fixed=(1, "l_quantity"), random=(1,), group="l_suppkey")
    return _card_eval(card, _t(spark, d, "lineitem"), None).select("l_orderkey", "l_linenumber", "l_extendedprice_hat")


def mixed_weighted(spark, d):
    card = MixedModelCard(target="o_totalprice", fixed=(1, "o_orderstatus"), random=(1,), group="o_orderpriority",
                          weights="o_custkey")
    return _card_eval(card, _t(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice_hat")


def glmm_binomial(spark, d):
    ev = _t(spark, d, "events").withColumn("is_purchase", (F.col("event_type") == "purchase").cast("int"))
    card = MixedModelCard(target="is_purchase", fixed=(1, "value"), random=(1,), group="user_id",
                          distribution="binomial")
    return _card_eval(card, ev, "event_id").select("event_id", "is_purchase_hat")


_reg("mixed_random_intercept", mixed_random_intercept, None)
_reg("glmm_binomial", glmm_binomial, None)
_reg("mixed_weighted", mixed_weighted, None)


# ---------------------------------------------------------------------------
# Files through load_files (S1, S2, S6, S7), the process flow (L21), an existing output column
# ---------------------------------------------------------------------------

from cardinal.plans.dashboard import process  # noqa: E402
from cardinal.session import checkpoint_dir  # noqa: E402
from cardinal.sources.readers import load_files  # noqa: E402
from cardinal.sources.tables import export_table  # noqa: E402


def _exported(spark, d, fmt):
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    orders = _t(spark, d, "orders").withColumn("opened", F.date_format(F.timestamp_seconds(F.col("o_orderkey") * 61), "HH:mm"))
    export_table(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "opened"), path, format=fmt)
    return path


def load_csv(spark, d):
    df = load_files(spark, [_exported(spark, d, "csv")], format="csv", nullstr="P")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "opened")


def load_json(spark, d):
    df = load_files(spark, [_exported(spark, d, "json")], format="json")
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"), F.max("opened").alias("last"))


_OPENED = "strftime(make_timestamp((o_orderkey * 61000000)::BIGINT), '%H:%M')"
_reg("load_csv", load_csv, f"""SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
  {_OPENED} AS opened FROM orders""")
_reg("load_json", load_json, f"""SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys, max({_OPENED}) AS last
  FROM orders GROUP BY o_orderstatus""")


def _exported_parts(spark, d, fmt):
    """Orders in files of three column sets; a price is text in one of them."""
    import uuid

    orders, root = _t(spark, d, "orders"), f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    sets = (["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey", "o_totalprice"], ["o_orderstatus", "o_orderkey", "o_shippriority"])
    files = []
    for i, cols in enumerate(sets):
        part = orders.withColumn("o_shippriority", F.concat(F.lit("p"), F.col("o_custkey") % 5)).where(F.col("o_orderkey") % 3 == i)
        export_table(part.select(*cols).repartition(24), f"{root}/{i}", format=fmt)
        files += spark.read.format(fmt).load(f"{root}/{i}").inputFiles()
    return files


def load_union_by_name(spark, d):
    return load_files(spark, _exported_parts(spark, d, "csv"), format="csv", union_by_name=True)


_reg("load_union_by_name", load_union_by_name, """
SELECT o_orderkey::INTEGER AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END::INTEGER AS o_custkey,
  CASE WHEN o_orderkey % 3 <> 1 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 3 = 2 THEN 'p' || (o_custkey % 5) END AS o_shippriority FROM orders""")


def load_union_by_position(spark, d):
    """Parquet files of orders, then of parts with other names, under the names of the first."""
    import uuid

    root = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    export_table(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), f"{root}/a", format="parquet")
    export_table(_t(spark, d, "part").select("p_partkey", "p_brand", "p_size"), f"{root}/b", format="parquet")
    return load_files(spark, [f"{root}/a", f"{root}/b"], format="parquet")


_reg("load_union_by_position", load_union_by_position, """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT p_partkey, p_brand, p_size::DOUBLE FROM part""")


def scoped_table_shares(spark, d):
    """Each line's share of its order, from a bucketed table that lives as long as the query: read twice, joined without a shuffle."""
    from cardinal.session import reliable_checkpoint
    from cardinal.sources.tables import with_table

    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    with with_table(lines, buckets=(8, ["l_orderkey"])) as name:
        total = spark.table(name).groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
        out = spark.table(name).join(total, "l_orderkey")
        return reliable_checkpoint(out.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("total")).alias("share")))


_reg("scoped_table_shares", scoped_table_shares, """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share FROM lineitem""")


def process_flow(spark, d):
    cards = [SplitCard(PercentileMethod(0.8), order_by=("o_orderdate",), group_by=("o_orderpriority",)),
             RescaleCard("minmax", inputs=("o_totalprice",), partition="partition")]
    out = process(_t(spark, d, "orders"), [ListFilter("o_orderstatus", ("F", "O"))], cards, order_rows_by=("o_orderkey",))
    return out.select("_id", "o_orderkey", "partition", "o_totalprice_rescaled")


_reg("process_flow", process_flow, """
WITH i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS _id FROM orders),
s AS (SELECT *, CASE WHEN percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) <= 0.8 THEN 1 ELSE 2 END AS "partition"
      FROM i WHERE o_orderstatus IN ('F', 'O')),
m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM s WHERE "partition" = 1)
SELECT _id, o_orderkey, "partition", (o_totalprice - lo) / (hi - lo) AS o_totalprice_rescaled FROM s JOIN m ON true""")


_reg("process_flow_file_order", process_flow_file_order, _REGISTRY["process_flow"][1].replace("OVER (ORDER BY o_orderkey)", "OVER ()"))


def cluster_existing_column(spark, d):
    from cardinal.plans.card import CardState

    cust = _t(spark, d, "customer").withColumn("part", (F.col("c_custkey") % 3).cast("int")).withColumn("cluster", -F.col("c_custkey"))
    card = ClusterCard(KMeansMethod(2), inputs=("c_acctbal",), partition="part")
    return card.transform(cust, CardState(content={"centres": [[0.0], [6000.0]]})).select("c_custkey", "cluster")


_reg("cluster_existing_column", cluster_existing_column, """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN -c_custkey WHEN abs(c_acctbal) <= abs(c_acctbal - 6000) THEN 1 ELSE 2 END::BIGINT AS cluster
FROM customer""")


# ---------------------------------------------------------------------------
# Training-data pipeline: present only with its subpackage and corpus_pipeline.py
# ---------------------------------------------------------------------------

try:
    from cardinal.llm.queries import ORACLES as _LLM_SQL
    from cardinal.llm.queries import QUERIES as _LLM_QUERIES
except ImportError:  # the subpackage or one of its optional packages is absent
    pass
else:
    for _name, _fn in _LLM_QUERIES.items():
        _reg(_name, _fn, _LLM_SQL.get(_name))

try:
    import corpus_pipeline as _pipeline
except ImportError:
    pass
else:
    _reg("pipeline", _pipeline.run, _pipeline.ORACLE_SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same column names, for every SQL-expressible query."""
    return {k: v[1] for k, v in _REGISTRY.items() if v[1]}

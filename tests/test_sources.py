import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cardinal.operators.rescale import RescaleCard
from cardinal.plans.flow import Node
from cardinal.sources import readers, tables
from tests.conftest import table


@pytest.fixture(scope="module")
def files(spark):
    base = tempfile.mkdtemp(prefix="cardinal-src-")
    df = spark.createDataFrame([(31, "peru"), (17, "chad"), (8, "oman")], "x long, y string")
    df2 = spark.createDataFrame([(40, "fiji"), (2, "mali")], "x long, y string")
    out = {}
    for fmt in ("csv", "json", "parquet"):
        for i, d in enumerate((df, df2)):
            tmpdir = os.path.join(base, f"{fmt}{i}")
            if fmt == "csv":
                d.coalesce(1).write.option("header", True).csv(tmpdir)
            else:
                d.coalesce(1).write.format(fmt).save(tmpdir)
            part = glob.glob(os.path.join(tmpdir, f"part-*.{fmt}" if fmt != "parquet" else "part-*.parquet"))[0]
            dest = os.path.join(base, f"file{i + 1}.{fmt}")
            os.link(part, dest)
            out.setdefault(fmt, []).append(dest)
    with open(os.path.join(base, "dates.csv"), "w") as f:
        f.write("trip, left, at, seen\n70, 28.02.2019, 6:40, 2019-02-28 06:41:00\n71, 01.03.2019, 23:07:30, 2019-03-02 00:00:00\n")
    out["dates"] = os.path.join(base, "dates.csv")
    out["base"] = base
    return out


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_two_files_one_scan_with_filename(spark, files, fmt):
    df = readers.load_files(spark, files[fmt], filename="file")
    rows = sorted((r.x, r.y, r.file) for r in df.collect())
    assert [r[0] for r in rows] == [2, 8, 17, 31, 40]
    assert {r[2] for r in rows} == {"file1", "file2"}
    req = readers.load_files(spark, {"files": [os.path.basename(p) for p in files[fmt]]}, base=files["base"])
    assert req.count() == 5


def test_union_by_name(spark, files, tmp_path):
    a = spark.createDataFrame([(1, "a")], "x long, y string")
    b = spark.createDataFrame([("b", 2, 9.0)], "y string, x long, z double")
    pa, pb = str(tmp_path / "a"), str(tmp_path / "b")
    a.write.parquet(pa)
    b.write.parquet(pb)
    df = readers.load_files(spark, [pa, pb], format="parquet", union_by_name=True)
    got = sorted((r.x, r.y, r.z) for r in df.collect())
    assert got == [(1, "a", None), (2, "b", 9.0)]


def test_dates_times_of_day_and_stamps(spark, files):
    assert readers.strptime_to_spark("%d.%m.%Y") == "d.M.yyyy"
    df = readers.load_files(spark, [files["dates"]], dateformat="%d.%m.%Y", columns={
        "trip": "int", "left": "date", "at": "string", "seen": "datetime"})
    assert [str(r.left) for r in df.orderBy("trip").collect()] == ["2019-02-28", "2019-03-01"]
    inferred = readers.load_files(spark, [files["dates"]])
    assert dict(inferred.dtypes)["at"] == "string" and dict(inferred.dtypes)["seen"].startswith("timestamp")
    assert [r["at"] for r in inferred.orderBy("trip").collect()] == ["6:40", "23:07:30"]


def test_partition_folders_are_a_switch(spark, tmp_path):
    table(spark, "nation").select("n_nationkey", "n_regionkey").write.partitionBy("n_regionkey").parquet(str(tmp_path / "p"))
    assert set(readers.load_files(spark, [str(tmp_path / "p")], format="parquet").columns) == {"n_nationkey", "n_regionkey"}
    off = readers.load_files(spark, [str(tmp_path / "p")], format="parquet", hive_partitioning=False)
    assert off.columns == ["n_nationkey"] and off.count() == 25
    leaf = glob.glob(str(tmp_path / "p" / "n_regionkey=2" / "*.parquet"))
    assert {r.n_regionkey for r in readers.load_files(spark, leaf, format="parquet").collect()} == {2}
    table(spark, "nation").select("n_nationkey", "n_regionkey").write.partitionBy("n_regionkey").json(str(tmp_path / "j"))
    assert readers.load_files(spark, [str(tmp_path / "j")], format="json").columns == ["n_nationkey"]


def test_delimiters_unknown_options_and_named_results(spark, tmp_path):
    p = tmp_path / "rows.tsv"
    p.write_text("k,v\n9,x\n")
    assert readers.load_files(spark, [str(p)], table="rows_view").columns == ["k", "v"]
    assert spark.table("rows_view").count() == 1
    p.write_text("k\tv\n9\tx\n")
    assert readers.load_files(spark, [str(p)], delim="\t").columns == ["k", "v"]
    for fmt, name in (("csv", "rows.tsv"), ("json", "rows.json"), ("parquet", "rows.parquet")):
        with pytest.raises(ValueError, match="unknown"):
            readers.load_files(spark, [str(tmp_path / name)], format=fmt, no_such_option=1)


def test_list_files(spark, files):
    got = {r.path for r in readers.list_files(spark, files["base"]).collect()}
    assert {"file1.csv", "file2.json", "file1.parquet", "dates.csv"} <= got


def test_export_csv_bytes(spark, tmp_path):
    df = spark.createDataFrame([(5, "nut, dry"), (-2, None)], "x long, y string").coalesce(1)
    tables.export_table(df.orderBy("x"), str(tmp_path / "out.csv"))
    part = glob.glob(str(tmp_path / "out.csv" / "part-*.csv"))[0]
    assert open(part).read() == 'x,y\n-2,\n5,"nut, dry"\n'
    tables.export_table(df.where("false"), str(tmp_path / "empty.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "empty.csv")).count() == 0


def test_macros_are_dropped(spark):
    table(spark, "region").createOrReplaceTempView("region_v")
    out = tables.execute_with_macros(spark, ["square(n BIGINT) RETURNS BIGINT RETURN n * n",
                                             "less(n BIGINT, m BIGINT) RETURNS BOOLEAN RETURN n < m"],
                                     "SELECT r_regionkey AS k, square(r_regionkey) AS s, less(r_regionkey, 2) AS l FROM region_v")
    assert sorted(tuple(r) for r in out.where("k > 0").collect()) == [(1, 1, True), (2, 4, False), (3, 9, False), (4, 16, False)]
    with pytest.raises(Exception):
        spark.sql("SELECT square(3)").collect()


def test_node_save_load_roundtrip(spark, tmp_path):
    ev = table(spark, "events")
    node = Node(RescaleCard("zscore", inputs=("value",), group_by=("event_type",)))
    node.fit(ev, "event_id")
    node.save(str(tmp_path / "node"))
    loaded = Node.load(spark, str(tmp_path / "node"))
    a = node.evaluate(ev, "event_id").select("event_id", "value_rescaled")
    b = loaded.evaluate(ev, "event_id").select("event_id", "value_rescaled")
    assert a.exceptAll(b).count() == 0 and loaded.card == node.card


def test_replace_and_delete_table(spark):
    n = tables.replace_table(spark, table(spark, "region"), "region_copy")
    assert n == 5
    assert tables.replace_table(spark, "SELECT * FROM region_copy WHERE r_regionkey < :k", "small", virtual=True,
                                params={"k": 2}) is None
    assert spark.table("small").count() == 2
    tables.delete_table(spark, "region_copy")
    tables.delete_table(spark, "small", virtual=True)
    assert not spark.catalog.tableExists("region_copy")


def test_csv_skip_leading_lines(spark, tmp_path):
    p = tmp_path / "skip.csv"
    p.write_text("# exported file\n# second comment\nx,y\n1,a\n2,b\n")
    df = readers.load_files(spark, [str(p)], skip=2)
    assert sorted((r.x, r.y) for r in df.collect()) == [(1, "a"), (2, "b")]


def test_nullstr_list_and_normalize(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("Col A,pm2.5\n1,NA\n2,-\n3,7\n")
    df = readers.load_files(spark, [str(p)], nullstr=["NA", "-"], normalize_names=True)
    assert df.columns == ["col_a", "pm2_5"]
    assert sorted((r.col_a, r.pm2_5) for r in df.collect()) == [(1, None), (2, None), (3, "7")]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_many_files_few_scans(spark, tmp_path):
    heads = ("a,b\n", "b,c\n", "c,a,d\n")
    for i in range(90):
        (tmp_path / f"f{i:03d}.csv").write_text(heads[i % 3] + ",".join(str(i * 10 + j) for j in range(3 if i % 3 == 2 else 2)) + "\n")
    files = sorted(glob.glob(str(tmp_path / "*.csv")))
    df = readers.load_files(spark, files, union_by_name=True, filename="src")
    assert df.columns == ["a", "b", "src", "c", "d"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3
    assert [r for r in _rows(df) if r[2] in ("f000", "f001", "f002")] == sorted(
        [(0, 1, "f000", None, None), (None, 10, "f001", 11, None), (21, None, "f002", 20, 22)], key=str)
    assert df.count() == 90


def test_by_name_widens_unlike_types(spark, tmp_path):
    for name, sql in (("a", "SELECT 1 AS k, 'x' AS v"), ("b", "SELECT 3000000000 AS k, 2.5D AS v, true AS w")):
        spark.sql(sql).write.parquet(str(tmp_path / name))
    df = readers.load_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")], format="parquet", union_by_name=True)
    assert dict(df.dtypes) == {"k": "bigint", "v": "string", "w": "boolean"}
    assert _rows(df) == [(1, "x", None), (3000000000, "2.5", True)]
    spark.sql("SELECT 1 AS k, array(1) AS v").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="united"):
        readers.load_files(spark, [str(tmp_path / "a"), str(tmp_path / "c")], format="parquet", union_by_name=True)


def test_by_position_under_the_first_names(spark, tmp_path):
    spark.sql("SELECT 1 AS x, 'p' AS y").write.parquet(str(tmp_path / "a"))
    spark.sql("SELECT 2L AS zz, 'q' AS aa").write.parquet(str(tmp_path / "b"))
    spark.sql("SELECT 'r' AS y").write.parquet(str(tmp_path / "c"))
    df = readers.load_files(spark, [str(tmp_path / n) for n in "abc"], format="parquet", filename="src")
    assert df.columns == ["x", "y", "src"]
    assert [r[:2] for r in _rows(df)] == [(1, "p"), (2, "q"), (None, "r")]
    with pytest.raises(ValueError, match="position"):
        spark.sql("SELECT 1 AS one").write.parquet(str(tmp_path / "d"))
        readers.load_files(spark, [str(tmp_path / n) for n in "ad"], format="parquet")
    (tmp_path / "1.json").write_text('{"y": 1, "x": "p"}\n{"y": 2, "x": "q"}\n')
    (tmp_path / "2.json").write_text('{"p": 7, "a": "r"}\n')
    (tmp_path / "3.json").write_text('{"x": "s"}\n\n')
    js = [str(tmp_path / f"{i}.json") for i in (1, 2, 3)]
    assert _rows(readers.load_files(spark, js).select("y", "x")) == [(1, "p"), (2, "q"), (7, "r"), (None, "s")]
    assert set(readers.load_files(spark, js, union_by_name=True).columns) == {"y", "x", "p", "a"}
    assert _rows(readers.load_files(spark, [js[0], js[2]]).select("y", "x")) == [(1, "p"), (2, "q"), (None, "s")]


def test_scoped_tables_are_dropped(spark):
    nation = table(spark, "nation")
    with tables.with_table(nation, buckets=(4, ["n_regionkey"])) as name:
        t = spark.table(name)
        both = t.alias("l").join(t.alias("r"), "n_regionkey")
        assert both.count() == 125 and spark.table(name).count() == 25
    assert not spark.catalog.tableExists(name)
    with pytest.raises(RuntimeError):
        with tables.with_table(nation, schema="scoped_area", partition_by=["n_regionkey"]) as name:
            assert spark.sql(f"SELECT * FROM {name} WHERE n_regionkey = 2").count() == 5
            raise RuntimeError
    assert not spark.catalog.tableExists(name)
    with pytest.raises(Exception, match="zero"):  # a query that fails while it is written leaves nothing behind
        with tables.with_table(nation.withColumn("bad", F.raise_error(F.lit("zero")).cast("int"))) as name:
            pass
    assert not [t.name for t in spark.catalog.listTables() if "_cardinal_tmp_" in t.name]
    with tables.with_table_names(spark, 2, virtual=True) as (a, b):
        nation.createOrReplaceTempView(a.strip("`"))
    with pytest.raises(ValueError):
        with tables.with_table_names(spark, 1, schema="s", virtual=True):
            pass

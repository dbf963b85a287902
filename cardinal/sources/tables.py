"""Catalog and sink operations.

Tables are Spark catalog tables, views are temp views.  Nothing here pulls
data through the driver except the bounded page export (S13).
"""

from __future__ import annotations

import contextlib
import itertools
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import qcol, quote


def table_name(name: str, schema: str | None = None) -> str:
    """Quoted, optionally schema-qualified identifier."""
    return f"{quote(schema)}.{quote(name)}" if schema else quote(name)


def replace_table(spark: SparkSession, query: DataFrame | str, name: str, *, schema: str | None = None,
                  virtual: bool = False, params: Mapping | Sequence | None = None) -> int | None:
    """Create or replace a table (returns its row count) or a view (returns None).

    The count of a table is read back from the written table's statistics
    job, not from the driver.
    """
    df = spark.sql(query, args=params) if isinstance(query, str) else query
    if virtual:
        if schema:
            raise ValueError("temporary views live in the session, not in a schema")
        df.createOrReplaceTempView(name)
        return None
    if schema:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(schema)}")
    full = table_name(name, schema)
    df.write.mode("overwrite").format("parquet").saveAsTable(full)
    return spark.table(full).count()


def delete_table(spark: SparkSession, name: str, *, schema: str | None = None, virtual: bool = False) -> None:
    """Drop a table or view if it exists."""
    if virtual:
        spark.catalog.dropTempView(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {table_name(name, schema)}")


def export_table(df: DataFrame, path: str, *, format: str | None = None, header: bool = True,
                 mode: str = "overwrite", **options: object) -> None:
    """Write a query result to files (S12): a directory of part files."""
    fmt = format or path.rsplit(".", 1)[-1].lower()
    w = df.write.mode(mode).options(**options)
    if fmt == "csv":
        w.option("header", header).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")


def json_array_page(df: DataFrame, limit: int = 1000) -> DataFrame:
    """One-row, one-column JSON array of a page.

    The array is one value, so a page must be bounded: more than ``limit``
    rows raise instead of gathering in one task.
    """
    rows = F.struct(*[qcol(c) for c in df.columns])
    page = df.limit(int(limit) + 1).agg(F.collect_list(rows).alias("rows"))
    too_many = F.raise_error(F.lit(f"a page of more than {limit} rows")).cast("string")
    return page.select(F.when(F.size("rows") > limit, too_many).otherwise(F.to_json("rows")).alias("json"))


def load_table(spark: SparkSession, data, name: str | None = None, *, schema: T.StructType | str | None = None) -> DataFrame:
    """Small in-memory columns (dict of lists / pandas / arrow) as a DataFrame."""
    if isinstance(data, Mapping):
        import pandas as pd
        data = pd.DataFrame(dict(data))
    df = spark.createDataFrame(data, schema=schema)
    if name:
        df.createOrReplaceTempView(name)
    return df


def initialize_table(spark: SparkSession, colnames: Sequence[str], coltypes: Sequence[str], name: str | None = None) -> DataFrame:
    """Empty table with the given typed columns."""
    st = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(colnames, coltypes)])
    df = spark.createDataFrame([], st)
    if name:
        df.createOrReplaceTempView(name)
    return df


def append_rows(df: DataFrame, name: str, *, schema: str | None = None) -> None:
    """Append a DataFrame's rows to an existing table."""
    df.write.mode("append").insertInto(table_name(name, schema))


_names = (f"_cardinal_tmp_{uuid.uuid4().hex[:8]}_{i}" for i in itertools.count())


@contextlib.contextmanager
def with_view(df: DataFrame, name: str | None = None) -> Iterator[str]:
    """Scoped temp view: created on entry, dropped on exit."""
    name = name or next(_names)
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


@contextlib.contextmanager
def with_table_names(spark: SparkSession, n: int, *, schema: str | None = None, virtual: bool = False,
                     cleanup: bool = True) -> Iterator[list[str]]:
    """``n`` unused names for tables of ``schema`` or for views, quoted for SQL.

    What exists under them at the end is dropped, after an error too, unless
    ``cleanup`` is false.  Names carry a random part, so sessions that share
    a catalog do not meet.
    """
    if virtual and schema:
        raise ValueError("temporary views live in the session, not in a schema")
    if schema:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(schema)}")
    plain = [next(_names) for _ in range(n)]
    try:
        yield [table_name(p, schema) for p in plain]
    finally:
        if cleanup:
            for p in plain:
                delete_table(spark, p, schema=schema, virtual=virtual)


@contextlib.contextmanager
def with_table(df: DataFrame | str, *, spark: SparkSession | None = None, schema: str | None = None,
               partition_by: Sequence[str] = (), buckets: tuple[int, Sequence[str]] | None = None) -> Iterator[str]:
    """A query's rows as a physical table under a name of its own for the block's duration.

    The query runs once, on entry; whatever reads the table in the block
    reads the same rows, however often.  ``partition_by`` lays the files
    out by column, ``buckets=(n, columns)`` in sorted buckets, so that
    several joins on these columns need no shuffle of this side.  The table
    and its files go at the end, also when writing them or the block fails;
    a DataFrame made from it must be computed inside.
    """
    spark = spark or (SparkSession.getActiveSession() if isinstance(df, str) else df.sparkSession)
    with with_table_names(spark, 1, schema=schema) as (name,):
        writer = (spark.sql(df) if isinstance(df, str) else df).write.format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if buckets:
            writer = writer.bucketBy(buckets[0], *buckets[1]).sortBy(*buckets[1])
        writer.saveAsTable(name)
        yield name


def colnames(df_or_table: DataFrame | str, spark: SparkSession | None = None) -> list[str]:
    """Column names of a DataFrame or catalog table."""
    if isinstance(df_or_table, DataFrame):
        return list(df_or_table.columns)
    return [c.name for c in spark.catalog.listColumns(df_or_table)]


def column_types(df: DataFrame) -> dict[str, str]:
    """name -> SQL type string, the DESCRIBE listing."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def execute(spark: SparkSession, sql: str, params: Mapping | Sequence | None = None) -> DataFrame:
    """Run SQL with named (``:x``) or positional (``?``) parameters."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def execute_with_macros(spark: SparkSession, macros: Sequence[str], sql: str | Callable[[], DataFrame],
                        params: Mapping | Sequence | None = None) -> DataFrame:
    """Run a query with temporary SQL functions defined for its duration.

    Each macro is a ``name(arg type, ...) RETURNS type RETURN expr`` body.
    The functions' bodies are part of the analysed plan, so the returned
    DataFrame stays lazy and runs after they are dropped.
    """
    created = []
    try:
        for m in macros:
            fname = m.split("(", 1)[0].strip()
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m}")
            created.append(fname)
        df = execute(spark, sql, params) if isinstance(sql, str) else sql()
        df.schema  # analysed while the functions exist
        return df
    finally:
        for fname in created:
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {fname}")

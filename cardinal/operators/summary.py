"""Column summaries.

Numerical columns (any number except booleans) are summarised by
``[min, max]``; other columns (strings, dates, booleans, ...) by their sorted
distinct values with NULL last.  All numerical extrema come from one
aggregation job.  Distinct values are computed per column as a distributed
``distinct`` (partial aggregation, no per-row collection), so a
high-cardinality column never becomes one giant array in a task or a list on
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardinal.functions.columns import asc, qcol
from cardinal.operators.ranking import RN, ordered_numbers

SUMMARY_SCHEMA = ("column_no int, name string, kind string, eltype string, position bigint, value string, "
                  "low double, high double")
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numerical(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def type_label(dtype: T.DataType) -> str:
    """Element-type label (A2)."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return dtype.simpleString()


@dataclass
class ColumnSummary:
    name: str
    kind: str  # "numerical" | "categorical"
    eltype: str
    summary: dict | None = None  # numerical: {"min": .., "max": ..}
    values: DataFrame | None = None  # categorical: sorted distinct values, NULL last (distributed, lazy)

    def head(self, n: int) -> list:
        """The first ``n`` values of a categorical column: a bounded part of the list."""
        return [r[0] for r in self.values.limit(n).collect()]


def numeric_extrema(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``<col>_min``, ``<col>_max`` for every numerical column."""
    cols = columns or [f.name for f in df.schema.fields if is_numerical(f.dataType)]
    aggs = []
    for c in cols:
        aggs += [F.min(qcol(c)).alias(f"{c}_min"), F.max(qcol(c)).alias(f"{c}_max")]
    return df.agg(*aggs)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one column, NULL last (A1 categorical, A7)."""
    return df.select(qcol(column).alias(column)).distinct().orderBy(asc(column))


def summarize(df: DataFrame) -> list[ColumnSummary]:
    """Summary of every column (A1 + A2): one aggregation for all numerical extrema, which alone reach the driver.

    The values of a categorical column are a DataFrame; ``summary_table``
    gives those of all columns at once.
    """
    fields = df.schema.fields
    num = [f.name for f in fields if is_numerical(f.dataType)]
    ext = numeric_extrema(df, num).first() if num else None
    out = []
    for f in fields:
        if f.name in num:
            ends = {"min": ext[f"{f.name}_min"], "max": ext[f"{f.name}_max"]}
            out.append(ColumnSummary(f.name, "numerical", type_label(f.dataType), ends))
        else:
            out.append(ColumnSummary(f.name, "categorical", type_label(f.dataType), values=distinct_values(df, f.name)))
    return out


def summary_table(df: DataFrame) -> DataFrame:
    """The summary of all columns as rows (column_no, name, kind, eltype, position, value, low, high).

    A numerical column is one row with its extrema as doubles; a categorical
    column one row per distinct value (as text), numbered from 1 in the order
    of the values' own type, NULL last.  All categorical columns go through one pass:
    (column, value) rows are made distinct in two levels (per task, then per
    value), and numbered by ranges, so neither a column nor a value is one
    task, and no list reaches the driver.
    """
    fields = list(enumerate(df.schema.fields, 1))
    num = [(k, f) for k, f in fields if is_numerical(f.dataType)]
    cat = [(k, f) for k, f in fields if not is_numerical(f.dataType)]
    spark, parts = df.sparkSession, []
    if num:
        ext = numeric_extrema(df, [f.name for _, f in num]).first()  # two numbers a column
        rows = [(k, f.name, "numerical", type_label(f.dataType), None, None,
                 *(None if ext[f"{f.name}_{e}"] is None else float(ext[f"{f.name}_{e}"]) for e in ("min", "max"))) for k, f in num]
        parts.append(spark.createDataFrame(rows, SUMMARY_SCHEMA))
    if cat:
        one = F.array(*[F.struct(F.lit(k).alias("column_no"), qcol(f.name).cast("string").alias("value"),
                                 sortable(qcol(f.name), f.dataType).alias("key")) for k, f in cat])
        found = df.select(F.explode(one).alias("v")).select("v.*").distinct()
        ranked = ordered_numbers(found, ["key", "value"], ["column_no"], tiebreak=["value"])
        names = F.create_map(*[F.lit(x) for k, f in cat for x in (k, f.name)])
        kinds = F.create_map(*[F.lit(x) for k, f in cat for x in (k, type_label(f.dataType))])
        none = F.lit(None).cast("double")
        parts.append(ranked.select("column_no", names[F.col("column_no")].alias("name"), F.lit("categorical").alias("kind"),
                                   kinds[F.col("column_no")].alias("eltype"), F.col(RN).alias("position"), "value",
                                   none.alias("low"), none.alias("high")))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], SUMMARY_SCHEMA)


def sortable(c: Column, dtype: T.DataType) -> Column:
    """Times as microseconds, dates as days, booleans as 0 and 1, so that their order is not that of their text; else 0."""
    if isinstance(dtype, T.BooleanType):
        return c.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return F.when(c.isNotNull(), F.lit(0).cast("bigint"))

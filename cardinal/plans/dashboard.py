"""The end-to-end flows a dashboard user runs.

Load + summarise, filter + row id + cards, fetch a sorted page, export.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinal.functions.columns import asc, desc, qcol
from cardinal.operators.filters import select
from cardinal.operators.ranking import SLICES, add_row_id
from cardinal.operators.summary import summarize
from cardinal.plans.flow import CardGraph
from cardinal.session import checkpoint_dir
from cardinal.sources.readers import load_files
from cardinal.sources.tables import export_table

SLICE_ROWS = 100_000


def load_and_summarize(spark: SparkSession, request: Mapping) -> tuple[DataFrame, list]:
    """Load files into the ``source`` view and summarise it."""
    df = load_files(spark, request)
    df.createOrReplaceTempView("source")
    return df, summarize(df)


def process(df: DataFrame, filters: Sequence = (), cards: Sequence = (), id_var: str = "_id",
            order_rows_by: Sequence[str] | None = None) -> DataFrame:
    """Row id (numbered *before* filtering), filters, then the card graph."""
    with_id = add_row_id(df, id_var, order_by=order_rows_by)
    selected = select(with_id, filters)
    if not cards:
        return selected
    return CardGraph(cards).train_evaljoin(selected, id_var)


def sort_columns(df: DataFrame, sort_model: Sequence[Mapping] = ()) -> list[Column]:
    """The sort expressions of a sort model; unknown columns are ignored; NULLS LAST both ways."""
    cols = []
    for s in sort_model:
        name = s.get("colId") or s.get("col")
        if name in df.columns:
            cols.append(desc(name) if str(s.get("sort", "asc")).lower() == "desc" else asc(name))
    return cols


def sort_page(df: DataFrame, sort_model: Sequence[Mapping] = ()) -> DataFrame:
    """Multi-column sort."""
    cols = sort_columns(df, sort_model)
    return df.orderBy(*cols) if cols else df


class PageIndex:
    """A table laid out for paging: sorted slices and the places of their rows.

    The rows are cut by ranges of the sort key (rows that tie are cut, too)
    into slices of about ``slice_rows`` rows, at most ``SLICES`` for each shuffle
    partition: what the driver holds of a slice (key sample, bounds, task, count)
    does not grow with the rows.  Each is sorted and written once, one folder a
    slice, below the shared checkpoint folder, with each row's place in it.
    The counts of the slices tell which of them hold an offset, and the places
    which of their rows: a page reads and sorts only these, however deep it
    lies, and the layout serves every page of the same sort.  Rows that tie follow a
    hash of the whole row, so pages neither repeat nor miss a row.  Use as a
    context manager, or call ``drop``: the layout is a copy of the table.
    """

    def __init__(self, df: DataFrame, sort_model: Sequence[Mapping] = (), slice_rows: int = SLICE_ROWS):
        spark = df.sparkSession
        self.columns, self.spark = list(df.columns), spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
        self.order = [*sort_columns(df, sort_model), asc("_cd_tie")]
        tied = df.withColumn("_cd_tie", F.xxhash64(*[qcol(c) for c in df.columns]))
        most = SLICES * int(spark.conf.get("spark.sql.shuffle.partitions"))
        slices = min(most, max(1, -(-df.count() // slice_rows)))
        cut = tied.repartitionByRange(slices, *self.order).withColumn("_cd_slice", F.spark_partition_id())
        cut = cut.sortWithinPartitions("_cd_slice", *self.order)
        cut = cut.withColumn("_cd_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))  # place in the slice
        cut.write.partitionBy("_cd_slice").parquet(self.path)
        self.table = spark.read.schema(cut.schema).parquet(self.path)
        counts = self.table.groupBy("_cd_slice").agg(F.count(F.lit(1)).alias("n"))
        self.counts = sorted((r["_cd_slice"], r["n"]) for r in counts.collect())  # one number a slice
        self.total = sum(n for _, n in self.counts)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset`` on, in order."""
        whole, cut, before = [], [], 0
        start, stop = int(offset), int(offset) + int(limit)
        for number, n in self.counts:
            if before + n > start and before < stop:
                if start <= before and before + n <= stop:
                    whole.append(number)
                else:  # the first and the last one at most
                    cut.append((number, start - before, stop - before))
            before += n
        part = self.table.where(F.col("_cd_slice").isin(whole))
        for number, low, high in cut:
            some = self.table.where((F.col("_cd_slice") == number) & (F.col("_cd_at") >= low) & (F.col("_cd_at") < high))
            part = part.union(some) if whole or number != cut[0][0] else some
        return part.orderBy(*self.order).limit(int(limit)).select(*[qcol(c) for c in self.columns])

    def drop(self) -> None:
        """Delete the layout."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)

    def __enter__(self) -> PageIndex:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def fetch_page(df: DataFrame, limit: int, offset: int = 0, sort_model: Sequence[Mapping] = ()) -> tuple[DataFrame, int]:
    """One sorted page and the total row count.

    Near the start the page is a top-k (no sort of the table); a page that ends
    beyond ``SLICE_ROWS`` rows, which would gather in one task, is read from a
    :class:`PageIndex`.  Callers that turn many pages keep an index of their own.
    """
    if offset + limit > SLICE_ROWS:
        index = PageIndex(df, sort_model)
        return index.page(limit, offset), index.total
    return sort_page(df, sort_model).offset(int(offset)).limit(int(limit)), df.count()


def export_processed(df: DataFrame, path: str, format: str = "csv") -> None:
    """Write the processed table."""
    export_table(df, path, format=format)

"""Operator 6 (native): shards by proportional stratified interleaving.

Rows are ranked inside their source in a seeded shuffle, and sorted by
*fractional* rank (rank - 1/2) / rows of the source.  In that order every
prefix, and so every run between two cuts, holds each source in its overall
proportion to within a row.  Cutting at floor(k * rows / shards) gives shards
whose row counts differ by one at most: the law is ``rows``.

Ranks in a source are numbered by a uniform hash, so 2**bits windows share even
a single source or a source with most rows (`common.seeded_ranks`).  Fractions
are not uniform - every source of one row has 1/2 - so the second order is cut
into slices of equal row counts on (fraction, source, rank), which divide
equal fractions too (`ranking.ordered_numbers`).  Only ids, sizes and checksums
are shuffled, never texts.  DataFrame functions only.

Cases: null source is a source of its own; null text has size 1 and the
checksum of an empty text; rows with equal id and text may swap places with
each other; equal texts are placed independently, as the mixture asks; no
rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import group_key, seeded_ranks, shuffle_key
from cardinal.operators.ranking import N, RN, ordered_numbers


def stratified_shards(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
                      source_col: str = "source", bits: int = 10) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (place in its shard), grown_shard (null), source."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.col(source_col).alias("source"),
        group_key(F.col(source_col)).alias("_group"), shuffle_key(seed, F.col(id_col), text).alias("_key"),
    )
    own = seeded_ranks(rows, "_group", "_key", (id_col, "text_crc32", "size"), bits)
    fraction = (2 * F.col("rank") - 1) / (2 * F.col("group_rows"))
    spread = own.select(
        id_col, "size", "text_crc32", "source", F.col("_group").alias("_stratum"), F.col("rank").alias("_rank"),
        (fraction * F.lit(2.0**62)).cast("long").alias("_key"),
    )
    order = ordered_numbers(spread, ["_key"], tiebreak=["_stratum", "_rank"])
    order = order.withColumnRenamed(RN, "rank").withColumnRenamed(N, "group_rows")
    at = F.col("rank") - 1
    shard = F.expr(f"((rank * {shards}) - 1) div group_rows")
    first = F.expr(f"(_shard * group_rows + {shards} - 1) div {shards}")
    return (
        order.withColumn("_shard", shard)
        .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
                (at - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
    )

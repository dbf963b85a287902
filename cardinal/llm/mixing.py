"""Operator 5 (native): sources mixed to target weights by Pfair scheduling.

A source with u of U units of weight owns u of every U slots.  Its block b
(from 1) is released at floor((b - 1) * U / u) and due at ceil(b * U / u); in
each slot the released block with the earliest deadline runs.  Weights add
up to one, so every slot is filled, no deadline is missed, and after any
number of slots each source is less than one block away from its exact share.

The schedule repeats every U slots (after U slots every source has had exactly
its u blocks), so one period is simulated, from the weights alone, by an
``aggregate`` expression, and every block finds its slot by joining with that
period: U rows at most, whatever the data.  The target weights hold only while
every source still has blocks: ``in_mixture`` marks the slots before the first
one whose source has run out.  No source ends the mixture, though: one that
has run out leaves its slots empty, and the others go on in their own
proportions.  `mix` returns all rows of the scheduled sources in the order of
their slots.  DataFrame functions only.

Cases: null source is a source of its own; a source of target weight zero is
never scheduled (slot null, left out by `mix`); the last block of a source may be short; rows
with equal id and text are interchangeable; no rows give no rows; extra
columns are ignored (`mix` keeps them).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardinal.llm.common import group_key, reliable_checkpoint, seeded_ranks, shuffle_key
from cardinal.operators.joins import broadcast_if_bounded

UNITS = 1000
BLOCK_ROWS = 8
TEMPERATURE = 0.7
#: Rows (of a name and a few numbers) up to which the per-source tables are broadcast; beyond, Spark joins by key.
MAX_BROADCAST = 100_000


def target_units(sources: DataFrame, weights: Mapping[str | None, float] | None, temperature: float,
                 units: int) -> DataFrame:
    """``g``, ``rows``, ``u``: each source's whole units, adding up to ``units`` (largest remainder).

    Without given weights a source's weight is its row count to the power
    ``temperature``.  Every source of positive weight gets a unit at least.
    """
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("g") == F.lit("" if name is None else f"={name}"), F.lit(float(w))).otherwise(weight)
    everyone = Window.partitionBy(F.lit(0))
    t = sources.withColumn("w", weight)
    t = t.withColumn("live", (F.col("w") > 0).cast("int"))
    t = t.withColumn("span", F.greatest(F.lit(units), 2 * F.sum("live").over(everyone)))
    share = F.try_divide((F.col("span") - F.sum("live").over(everyone)) * F.col("w"), F.sum("w").over(everyone))
    t = t.withColumn("share", F.coalesce(share, F.lit(0.0)))
    t = t.withColumn("whole", F.floor(F.col("share") + 1e-9))  # equal sources get whole shares despite rounding
    spare = F.col("span") - F.sum("live").over(everyone) - F.sum("whole").over(everyone)
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.col("live").desc(), (F.col("share") - F.col("whole")).desc(), "g")
    extra = ((F.row_number().over(by_rest) <= spare) & (F.col("live") == 1)).cast("long")
    return t.select("g", "rows", (F.col("live") + F.col("whole") + extra).alias("u"), "span")


#: One period by earliest deadline first: the index of the source that runs in each slot.
PERIOD = """
aggregate(
  sequence(0L, span - 1),
  named_struct('done', transform(us, u -> 0L), 'picks', cast(array() as array<int>)),
  (acc, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(us) - 1), i -> us[i] > 0 and (acc.done[i] * span) div us[i] <= t),
      i -> named_struct('due', ((acc.done[i] + 1) * span + us[i] - 1) div us[i], 'i', i))).i),
    p -> named_struct('done', transform(acc.done, (x, i) -> if(i = p, x + 1, x)),
                      'picks', concat(acc.picks, array(p))))[0],
  acc -> acc.picks)
"""


def period(units: DataFrame) -> DataFrame:
    """``g``, ``j`` (the source's block in the period, from 1), ``at`` (its slot): U rows."""
    one = units.where("u > 0").groupBy("span").agg(F.sort_array(F.collect_list(F.struct("g", "u"))).alias("s"))
    one = one.select("span", "s", F.col("s.u").alias("us"))
    slots = one.select("s", F.posexplode(F.expr(PERIOD)).alias("at", "i"))
    slots = slots.select(F.expr("s[i].g").alias("g"), F.col("at").cast("long"))
    return slots.withColumn("j", F.row_number().over(Window.partitionBy("g").orderBy("at")).cast("long"))


def placed(rows: DataFrame, id_col: str, weights: Mapping[str | None, float] | None, temperature: float, units: int,
           block_rows: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` (with ``g`` and ``key``) and each one's rank, block and slot; the sources' units; the period."""
    sources = rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    goal = reliable_checkpoint(target_units(sources, weights, temperature, units))  # a row per source
    slots = reliable_checkpoint(period(goal))  # U rows
    ranked = seeded_ranks(rows, "g", "key", (id_col,), bits).drop("group_rows")
    ranked = ranked.withColumn("block", F.expr(f"(rank - 1) div {block_rows} + 1"))
    aim, _ = broadcast_if_bounded(goal.select("g", "u", "span"), MAX_BROADCAST)  # a row per source
    timed = ranked.join(aim, "g").withColumn("j", F.expr("(block - 1) % nullif(u, 0) + 1"))
    timed = timed.join(broadcast_if_bounded(slots, MAX_BROADCAST)[0], ["g", "j"], "left")  # U rows
    return timed.withColumn("slot", F.expr("((block - 1) div nullif(u, 0)) * span + at")), goal, slots


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = TEMPERATURE,
             units: int = UNITS, block_rows: int = BLOCK_ROWS, seed: int = 0, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", bits: int = 10) -> DataFrame:
    """Per row: id, source, block, release, deadline, slot, in_mixture, and its seeded key and rank."""
    rows = docs.select(
        F.col(id_col), F.col(source_col).alias("source"), group_key(F.col(source_col)).alias("g"),
        shuffle_key(seed, F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
    )
    timed, goal, slots = placed(rows, id_col, weights, temperature, units, block_rows, bits)
    last = goal.where("u > 0").withColumn("b", F.expr(f"(rows + {block_rows} - 1) div {block_rows}"))
    ends = last.select("g", F.expr("b % u + 1").alias("j"), F.expr("(b div u) * span").alias("base"))
    end = ends.join(slots, ["g", "j"]).agg(F.min(F.col("base") + F.col("at"))).first()[0]
    return timed.select(
        id_col, "source", "block", F.expr("((block - 1) * span) div nullif(u, 0)").alias("release"),
        F.expr("(block * span + u - 1) div nullif(u, 0)").alias("deadline"), "slot",
        F.coalesce(F.col("slot") < F.lit(end), F.lit(False)).alias("in_mixture"), F.col("g").alias("_g"),
        F.col("key").alias("_key"), F.col("rank").alias("_rank"),
    )


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = TEMPERATURE,
        units: int = UNITS, block_rows: int = BLOCK_ROWS, seed: int = 0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", bits: int = 10) -> DataFrame:
    """The rows of all sources of positive weight, all columns kept, in the order of their slots.

    The first slots hold the target weights; after a source's last block the
    others go on without it.  Rows are shuffled twice with their texts: for
    the rank in their source, and into the order of the slots.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), group_key(F.col(source_col)).alias("g"),
        shuffle_key(seed, F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
    )
    timed, _, _ = placed(rows, "_id", weights, temperature, units, block_rows, bits)
    return timed.where("slot is not null").orderBy("slot", "rank").select("_row.*")

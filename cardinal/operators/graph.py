"""Connected components of an edge table.

Alternating large-star and small-star rounds: both keep the components and
never add edges, and they end with a star around each component's smallest
node.  Every round is written into the shared checkpoint folder and observed
on the way, so that an unchanged round ends the loop; it is read as a plain
file, so that a round is planned from its own size and not from all before it.

A star's centre is one key with as many rows as the component has nodes.  Its
smallest neighbour is found by a pre-aggregated minimum, and the join that
hands it to the centre's rows is salted: the one row of each node is repeated
``SALTS`` times, the rows of a centre are dealt over the salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cardinal.session import stored

SALTS = 16


def observed(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs (u, v), stored, with their number and the sum of their hashes."""
    seen = Observation()
    kept = stored(pairs.observe(seen, F.count(F.lit(1)).alias("n"),
                               F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    got = seen.get
    return kept, (got["n"], got["h"])


def with_smallest(pairs: DataFrame, with_self: bool) -> DataFrame:
    """Add ``m``, the smallest ``v`` of each ``u`` (``with_self``: or ``u`` itself)."""
    least = F.least("u", F.min("v")) if with_self else F.min("v")
    low = pairs.groupBy("u").agg(least.alias("m"))
    low = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(low, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 200) -> DataFrame:
    """(``node``, ``component`` = smallest node reachable) for the nodes that have an edge to another node.

    Reaching ``max_rounds`` raises instead of returning a partial result.
    """
    cur = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    cur, state = observed(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # Large star: every neighbour larger than the node points to the node's smallest neighbour (or the node).
        both = cur.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        large = with_smallest(both.select("e.u", "e.v"), True).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # Small star: the node and its smaller neighbours point to the smallest of them.
        small = with_smallest(large, False).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        # Pairs (node, smaller neighbour) only move down: an unchanged set is a fixed point.
        nxt, now = observed(small.where("u != v").distinct())
        if now == state:
            break
        cur, state = nxt, now
    else:
        raise RuntimeError("components did not settle")
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))

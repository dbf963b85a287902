"""Score a stream with fitted, frozen nodes.

Per-row cards (rescale, gaussian encoding, cluster assignment, dimensionality
reduction, GLM and network predictions) are stateless projections or a
stream-static join with small fitted statistics, so a fitted graph applies
to a Structured Streaming DataFrame unchanged.  Cards that need the whole
table (splits, windows, interpolation) are rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cardinal.plans.flow import Node
from cardinal.session import checkpoint_dir


def apply_frozen(stream: DataFrame, nodes: Sequence[Node], id_var: str | None = None) -> DataFrame:
    """Evaluate fitted nodes on a (streaming) DataFrame without training."""
    out = stream
    for n in nodes:
        if not getattr(n.card, "streamable", True):
            raise ValueError(f"card {n.card.type!r} needs the whole table and cannot score a stream")
        out = n.evaluate(out, id_var)
    return out


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """File stream over a directory (``glob`` keeps matching file names only)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_to_table(stream: DataFrame, nodes: Sequence[Node], name: str, id_var: str | None = None,
                   sink_path: str | None = None) -> DataFrame:
    """Run the scoring stream to completion (available-now trigger) and return the result.

    Results are appended as parquet files (a durable sink, exactly-once
    through the checkpoint) in ``sink_path``, by default a fresh folder below the
    shared checkpoint folder, and are registered as the view ``name``.
    """
    scored = apply_frozen(stream, nodes, id_var)
    spark = stream.sparkSession
    own = f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    sink_path = sink_path or f"{own}/result"
    query = (scored.writeStream.option("checkpointLocation", f"{own}/state").trigger(availableNow=True)
             .format("parquet").option("path", sink_path).outputMode("append").start())
    query.awaitTermination()
    result = spark.read.schema(scored.schema).parquet(sink_path)
    result.createOrReplaceTempView(name)
    return result


# Fixed-size batch iteration (T1) is distributed: see
# ``cardinal.operators.funnel.with_batches`` and ``map_batches``.

"""Session helpers: configuration defaults and lineage cutting.

Cluster jobs read the shared checkpoint folder from ``spark.checkpoint.dir``.
Only a local-mode session without that setting (tests, benches) gets a fresh
scratch folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "cardinal") -> SparkSession:
    """Create (or reuse) a session tuned for the library.

    AQE stays on so that coalescing and skew-join splitting happen at run
    time; the UI is off (no port is opened beyond Spark's own RPC).
    """
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it into the context.

    The folder named by ``spark.checkpoint.dir`` wins.  Without it, a local
    session gets a fresh scratch folder; a cluster session must name one.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="cardinal-ckpt-")
    sc.setCheckpointDir(path)
    return path


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where later steps must see exactly the same rows twice (e.g. a
    range-partitioned table whose partition ids feed an offset table) and by
    iterative fits; it survives executor loss, unlike a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder, and read from there.

    A checkpoint keeps the size estimate and the constraints of the plan it
    was made from.  A join's estimate is the product of its sides, so over the
    rounds of a loop it becomes a number of millions of digits, which the
    driver multiplies.  Files have their own size and no constraints: plans
    cost the same in every round, and columns that are not asked for are not read.
    The order and the partitions of the rows are not kept.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

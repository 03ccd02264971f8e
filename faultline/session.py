"""Session helpers: session creation for local use, checkpointing and size checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Above this optimizer estimate an input is treated as large.
SMALL_BYTES = 1 << 30


def local_session(app: str = "faultline", cpus: int | str = "*") -> SparkSession:
    """Session for tests and benchmarks; on a cluster, use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide projections of this library profit from.

    Methods above 8000 bytes of bytecode are not compiled by the JVM's JIT; with this
    limit Spark generates split methods for such projections instead of one huge one.
    A value the user has set is left alone.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return a plan that reads it.

    Reliable checkpoints survive executor loss. A folder set by the cluster is
    used as it is; only a session without one (tests) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="faultline-ckpt-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, per_task: int, rows: int | None = None) -> DataFrame:
    """``df`` dealt out by ``key`` over as many tasks as hold about ``per_task`` of ``rows`` (its own, if not given).

    The number of tasks follows the rows, so what a task holds doesn't grow with the table, and a small table
    that is kept and scanned often isn't read by hundreds of tasks. There is at least one task for each core.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)), key)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; runs no job."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """True if the optimizer can bound ``df`` below ``limit`` bytes."""
    return estimated_bytes(df) <= limit

"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the operators rely on. Skewed join partitions are split even
# where that costs an extra shuffle further up the plan.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # generated methods above this size are not compiled by the JVM
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# below this many rows a frame is spread over all cores before heavy work
SPREAD_ROWS = 10_000_000


def local_session(cores: str = "*", app: str = "tableprep", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("TABLEPREP_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoints no frame refers to any more are deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, or a private one in local mode."""
    sc = spark.sparkContext
    shared, current = spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if current and (not shared or shared.rstrip("/") in current):
        return current
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tableprep-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there from now on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """Give heavy work on a small table as many tasks as there are cores.

    A small file is read by one task. Large tables have enough splits and pass
    through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *(keys or df.columns)) if rows <= SPREAD_ROWS else df


def broadcast_if_small(df: DataFrame, rows: int = 500_000, cut: bool = True) -> DataFrame:
    """Store a side table and mark it for broadcast if it has at most ``rows`` rows.

    Meant for narrow tables of counts and keys; a larger one stays an ordinary
    join side, which adaptive execution may split. ``cut=False`` takes a table
    that is stored already.
    """
    stored = cut_lineage(df) if cut else df
    return F.broadcast(stored) if stored.count() <= rows else stored

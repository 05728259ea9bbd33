"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "entitymill", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # HotSpot does not compile methods beyond 8,000 bytes of bytecode; the long cleaning
        # projections run faster as several operators than as one interpreted method
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it and the checkpoint would not survive them.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="entitymill-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` on reliable storage and restart its plan from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which a driver with
    a large heap may not do for half an hour; loops that cut their lineage in
    every round would keep the files of all rounds until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored there, in any file system Spark reads; other errors are raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table; nothing happens if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

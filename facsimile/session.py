"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # smaller generated methods keep wide one-pass aggregates inside the JIT's limits
    "spark.sql.codegen.methodSplitThreshold": "256",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "facsimile", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    On a cluster pass ``master=None`` and let spark-submit decide; for local runs the
    shuffle partition count should follow the core count, not Spark's 200.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (HDFS, S3, ...); it is an error if it
    is not, since executors do not share a machine's own folder.  Only a local master
    gets a private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="facsimile-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/facsimile/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a frame that reads it.

    Later passes read the files, so a lost executor never replays what came before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never a local one) so a lost executor cannot force a long replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # noqa: BLE001
        return os.cpu_count() or 8


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt to as many tasks as the shuffle parallelism, each with at least ``rows`` rows or so.

    For work that costs far more a row than its bytes say: a scan cuts its files by size,
    so a small file is one task.  A frame with as many partitions already stays as it is.
    """
    target = default_parallelism(df.sparkSession)
    parts = df.rdd.getNumPartitions()
    if parts >= target:
        return df
    tasks = min(target, -(-df.count() // rows))
    return df.repartition(tasks) if tasks > parts else df


REUSE_MAX_BYTES = 8 << 30   # default for spark.facsimile.reuse.maxBytes


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan (parquet: file size scaled to the projected columns)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


@contextmanager
def reused(df: DataFrame, max_bytes: int | None = None):
    """Keep a (projected) input that several passes will scan.

    Persisted (memory, spilling to disk; lost blocks are recomputed from the source)
    only when the optimizer's size estimate is at most ``spark.facsimile.reuse.maxBytes``
    -- beyond that, re-scanning the columnar source is the cheaper plan.  A frame with
    fewer partitions than the shuffle parallelism is spread first so every core works.
    Frames that are already cached are used as they are.
    """
    spark = df.sparkSession
    if df.storageLevel != StorageLevel(False, False, False, False, 1):
        yield df
        return
    limit = max_bytes if max_bytes is not None else int(
        spark.conf.get("spark.facsimile.reuse.maxBytes", str(REUSE_MAX_BYTES)))
    size = estimated_bytes(df)
    if size is None or size > limit:
        yield df
        return
    target = default_parallelism(spark)
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access
        parts = target
    d = df.repartition(target) if parts < target else df
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield d
    finally:
        d.unpersist()

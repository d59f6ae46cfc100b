"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(
    master: str | None = None,
    app: str = "hostscope",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    On a cluster, leave ``master`` unset and let the launcher decide; the
    defaults here only switch on AQE (partition coalescing and skew-join
    splitting), keep the UI off and pin the session time zone to UTC.
    ``spark.checkpoint.dir`` is taken from the cluster configuration; a
    local temporary folder is set only when none is configured and the
    master is local (tests).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # remove checkpoint files once the checkpointed data is unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    The cluster names it in ``spark.checkpoint.dir``.  Only when that is
    unset and Spark runs in local mode is a temporary folder used.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    base = base or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        base = tempfile.mkdtemp(prefix="hostscope-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts, uuid.uuid4().hex)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own on any file system Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the given Hadoop paths (metadata only, no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            total += fs.getContentSummary(path).getLength()
    return int(total)


def size_shuffles(spark: SparkSession, nbytes: int, target: int = TARGET_PARTITION_BYTES,
                  lo: int = 200, hi: int = 400_000) -> int:
    """Set the shuffle partition count so a shuffle of ``nbytes`` lands near
    ``target`` bytes per partition (AQE coalesces smaller ones at run time;
    skewed ones are split).  Returns the count used."""
    n = max(lo, min(hi, -(-nbytes // target)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target // 2))
    return n


#: Rows for one task where a row takes tenths of a millisecond: host features, tree scores.
TASK_ROWS = 20_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt over tasks of about ``rows`` rows each.  A small file of many rows
    comes as one task, and what is computed per row, or cached, would stay in it; so
    do this on narrow rows, before the costly columns.  A table of at most ``rows``
    rows stays as it is.  Counting a Parquet table reads its footers only.

    Spark moves a filter, with the columns it is made of, before a repartition, so
    into the one task; it does not pass a filter that depends on the partition."""
    n = -(-df.count() // rows)
    return df.repartition(n).where(F.spark_partition_id() >= 0) if n > 1 else df

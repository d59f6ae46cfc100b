"""Slices of the scan log: what each batch adds to the statistics, and its newest row.

Beside a log lies ``<log>.index``, one slice a batch: rows per label, phishing rows
per TLD with the least id, and the number of dated rows with the greatest ``ts``.
Slices are mergeable, so the statistics of the log (R2, G4) are their sums, and the
history (O2) reads only batches that can hold one of its rows.

A slice names the files it was made from.  Every write of a batch makes files of new
names, so a slice whose batch was replaced, by a replayed stream or a second import,
is told from the listing alone and made anew; nothing is counted twice and no writer
has to take part.  Making slices reads only the batches that need one.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostscope.functions import lists
from hostscope.operators.scanlog import history_of, log_partials, merged, stats_of
from hostscope.session import remove_path
from hostscope.sources.feeds import path_exists
from hostscope.sources.tables import SCAN_SCHEMA

SLICE_SCHEMA = "kind string, key string, n long, first_id long, newest timestamp, batch_id int"
_LOG_SCHEMA = T.StructType([*SCAN_SCHEMA.fields, T.StructField("batch_id", T.IntegerType())])
FILES, DATED = "files", "dated"  # kinds besides those of the statistics


def index_path(log: str) -> str:
    return f"{log.rstrip('/')}.index"


def _batch_files(spark: SparkSession, paths: list[str]) -> dict[int, str]:
    """Batch number -> mark of its files, from the listing."""
    names: dict[int, list[str]] = {}
    for path in spark.read.schema(SCAN_SCHEMA).parquet(*paths).inputFiles():
        found = re.search(r"/batch_id=(\d+)/([^/]+)$", path)
        if found:
            names.setdefault(int(found[1]), []).append(found[2])
    return {n: hashlib.md5("\n".join(sorted(files)).encode()).hexdigest() for n, files in names.items()}


def _slices(spark: SparkSession, log: str) -> DataFrame:
    path = index_path(log)
    if path_exists(spark, path):
        return spark.read.schema(SLICE_SCHEMA).parquet(path)
    return spark.createDataFrame([], SLICE_SCHEMA)


def _write_slices(spark: SparkSession, log: str, marks: dict[int, str]) -> None:
    """Make the slices of the named batches, in one pass over those batches."""
    if not marks:
        return
    log = log.rstrip("/")
    rows = (
        spark.read.option("basePath", log).schema(_LOG_SCHEMA)
        .parquet(*[f"{log}/batch_id={n}" for n in marks]))
    sums = log_partials(rows, "batch_id").withColumn("newest", F.lit(None).cast("timestamp"))
    dated = rows.where(F.col("ts").isNotNull()).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest")
    ).select(F.lit(DATED).alias("kind"), F.lit(None).cast("string").alias("key"), "n",
             F.lit(None).cast("long").alias("first_id"), "newest", "batch_id")
    files = spark.createDataFrame([(FILES, mark, 0, None, None, n) for n, mark in marks.items()], SLICE_SCHEMA)
    out = sums.unionByName(dated).unionByName(files)
    (out.repartition("batch_id").write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy("batch_id").parquet(index_path(log)))


def index_batch(spark: SparkSession, log: str, batch_id: int) -> None:
    """Make the slice of one batch that was just written."""
    _write_slices(spark, log, _batch_files(spark, [f"{log.rstrip('/')}/batch_id={batch_id}"]))


def refresh_index(spark: SparkSession, log: str) -> list[int]:
    """Make the slices that are missing or older than their batch, drop those of
    batches that are gone; returns the batches read."""
    marks = _batch_files(spark, [log]) if path_exists(spark, log) else {}
    known = {r.batch_id: r.key for r in _slices(spark, log).where(F.col("kind") == FILES).collect()}
    for gone in set(known) - set(marks):
        remove_path(spark, f"{index_path(log)}/batch_id={gone}")
    stale = {n: mark for n, mark in marks.items() if known.get(n) != mark}
    _write_slices(spark, log, stale)
    return sorted(stale)


def log_sums(spark: SparkSession, log: str) -> DataFrame:
    """``kind, key, n, first_id`` over the whole log, from its slices."""
    refresh_index(spark, log)
    return merged(_slices(spark, log).where(~F.col("kind").isin(FILES, DATED)))


def indexed_stats(spark: SparkSession, log: str, k: int = lists.TOP_TLDS) -> DataFrame:
    """G4 of the log without reading it: the slices, summed."""
    return stats_of(log_sums(spark, log), k)


def newest_batches(spark: SparkSession, log: str, limit: int) -> list[int] | None:
    """The batches that can hold one of the ``limit`` newest rows; None for all.

    The newest batches that have ``limit`` dated rows between them are read; the last
    of those rows bounds what older batches may add, so only batches whose newest row
    is not before it are needed."""
    refresh_index(spark, log)
    dated = _slices(spark, log).where(F.col("kind") == DATED).select("batch_id", "n", "newest")
    first, rows = [], 0
    for r in dated.orderBy(F.desc("newest"), "batch_id").limit(limit).collect():  # a row each at least
        first.append(r.batch_id)
        rows += r.n
        if rows >= limit:
            break
    if rows < limit:
        return None
    last = _read(spark, log, first).select("ts").orderBy(F.desc("ts")).limit(limit).agg(F.min("ts").alias("ts"))
    return sorted(r.batch_id for r in dated.join(last, F.col("newest") >= F.col("ts")).select("batch_id").collect())


def _read(spark: SparkSession, log: str, batches: list[int] | None) -> DataFrame:
    paths = [log] if batches is None else [f"{log.rstrip('/')}/batch_id={n}" for n in batches]
    return spark.read.schema(SCAN_SCHEMA).parquet(*paths)


def indexed_history(spark: SparkSession, log: str, limit: int = lists.HISTORY_LIMIT, rules: DataFrame | None = None) -> DataFrame:
    """O2 + L4: the newest rows of the log; batches that cannot hold one stay closed."""
    if not path_exists(spark, log):
        return history_of(spark.createDataFrame([], SCAN_SCHEMA), limit, rules)
    return history_of(_read(spark, log, newest_batches(spark, log, limit)), limit, rules)

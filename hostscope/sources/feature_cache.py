"""Keyed feature cache (S8, S9, D4, J2, L3): one row a domain, bucketed by the domain.

The cache is a Parquet table of ``n`` buckets by the hash of ``domain``, sorted within
them.  Joins and anti-joins on the domain read it bucket by bucket: only the other side
is shuffled, however large the cache is.  ``upsert`` extracts and adds only domains the
cache lacks, each once, so a domain has one row on write and readers need no dedupe.
One writer at a time, as for any table without transactions.

The number of buckets is kept beside the table (``<path>.buckets``), so another session
finds it again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.sources.feeds import path_exists

KEY = "domain"


def _spec(path: str) -> str:
    return f"{path.rstrip('/')}.buckets"


def is_keyed(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, _spec(path)) and path_exists(spark, path)


def _name(path: str) -> str:
    return "feature_cache_" + hashlib.md5(path.encode()).hexdigest()


def _table(spark: SparkSession, path: str) -> tuple[str, int]:
    """The session's table over the cache, and its number of buckets."""
    buckets, schema = spark.read.parquet(_spec(path)).select("buckets", "columns").first()
    name = _name(path)
    if not spark.catalog.tableExists(name):
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                  f"INTO {buckets} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)
    return name, buckets


def _write(rows: DataFrame, name: str, path: str, buckets: int, mode: str) -> None:
    # dealt by the buckets' own hash, so a bucket is one file a write
    (rows.repartition(buckets, KEY).write.format("parquet").mode(mode).bucketBy(buckets, KEY).sortBy(KEY)
     .option("path", path).saveAsTable(name))


def create_cache(features: DataFrame, path: str, buckets: int | None = None) -> None:
    """A new cache of ``features`` (``domain`` and feature columns), one row a domain;
    rows without a domain are left out.  ``buckets``: by default one a shuffle
    partition, which ``session.size_shuffles`` fits to the input."""
    spark = features.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = features.drop("label").where(F.col(KEY).isNotNull()).dropDuplicates([KEY])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    _write(rows, _name(path), path, buckets, "errorifexists")
    spark.createDataFrame([(buckets, columns)], "buckets int, columns string").coalesce(1).write.parquet(_spec(path))


def open_cache(spark: SparkSession, path: str, required: Sequence[str] = lists.FEATURE_ORDER) -> DataFrame | None:
    """The cache, if it is there and has every model column."""
    if not is_keyed(spark, path):
        return None
    rows = spark.table(_table(spark, path)[0])
    return rows if set(required) <= set(rows.columns) else None


def missing_domains(spark: SparkSession, domains: DataFrame, path: str) -> DataFrame:
    """The distinct domains the cache lacks; the cache is read where it lies."""
    name, buckets = _table(spark, path)
    # each domain once (combined before the shuffle), then dealt as the buckets are
    wanted = domains.select(KEY).where(F.col(KEY).isNotNull()).distinct().repartition(buckets, KEY)
    # an outer join and a test, as the planner would push an anti-join below the dealing
    # and then shuffle the cache
    cached = spark.table(name).select(KEY, F.lit(True).alias("__cached"))
    return wanted.join(cached, KEY, "left").where(F.col("__cached").isNull()).select(KEY)


def upsert(spark: SparkSession, domains: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """S9 + L3: extract the features of the domains the cache lacks and add them."""
    name, buckets = _table(spark, path)
    new = extract(missing_domains(spark, domains, path))
    _write(new.select(*spark.table(name).columns), name, path, buckets, "append")
    spark.catalog.refreshTable(name)

"""Scan log and corrections tables.

Both are append-only Parquet tables of ``batch_id=<n>`` folders.  An append
without a number takes the next free one and never touches rows that are there;
a caller that names a batch (a stream replaying it) replaces that batch alone.
Streams number from ``STREAM_BASE``, so they share a log with other writers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostscope.functions import lists
from hostscope.functions.urls import py_strip
from hostscope.operators.features import FEATURE_COLUMNS
from hostscope.sources.feeds import path_exists

FEATURE_STRUCT = T.StructType(
    [T.StructField(c, T.StringType() if c == "tld" else
                   (T.DoubleType() if c in ("entropy", "unicode_ratio") else T.IntegerType()))
     for c in FEATURE_COLUMNS]
)

SCAN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("features", FEATURE_STRUCT),
])


ID_BITS = 43  # ids of one batch number: 1,024 partitions; a wider write takes more numbers
STREAM_BASE = 1 << 19  # batch numbers of streams


def batch_ids(batch_id: int) -> Column:
    """Unique ids of one write: ``batch_id << 43`` plus the partition-local id.
    A write of more than 1,024 partitions reaches into the following numbers,
    which ``next_batch`` then skips."""
    return (F.lit(batch_id).cast("long") * F.lit(1 << ID_BITS)) + F.monotonically_increasing_id()


def next_batch(spark: SparkSession, path: str) -> int:
    """The first batch number below ``STREAM_BASE`` that neither a folder nor an
    id in the table uses."""
    n = 0
    if path_exists(spark, path):
        ids = spark.read.schema("id long").parquet(path).where(F.col("id") < (STREAM_BASE << ID_BITS))
        top = ids.agg(F.max("id")).first()[0]  # from column statistics, not from rows
        n = 0 if top is None else (top >> ID_BITS) + 1
    while path_exists(spark, f"{path}/batch_id={n}"):
        n += 1
    return n


def claim_number(spark: SparkSession, log: str, owner: str, batch_id: int) -> int:
    """The log's number for micro-batch ``batch_id`` of the stream that keeps its
    offsets under ``owner``.  A number is claimed by creating ``<log>.claims/<n>``,
    which only one writer can, and noted under ``<owner>/numbers``; a replay finds
    the note, so it writes the same number again.  A crash between the two leaves a
    number unused, never used twice."""
    notes, claims = f"{owner.rstrip('/')}/numbers", f"{log.rstrip('/')}.claims"
    noted = f"{notes}/{batch_id}"
    if path_exists(spark, noted):
        return int(_read_note(spark, noted))
    before = f"{notes}/{batch_id - 1}"
    n = int(_read_note(spark, before)) + 1 if path_exists(spark, before) else STREAM_BASE
    while path_exists(spark, f"{log}/batch_id={n}") or not _create(spark, f"{claims}/{n}", ""):
        n += 1
    # a note is whole or absent
    fs, path = _fs(spark, f"{noted}.new")
    if path_exists(spark, f"{noted}.new"):
        fs.delete(path, False)
    _create(spark, f"{noted}.new", str(n))
    fs.rename(path, _fs(spark, noted)[1])
    return n


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False if there is one already."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as exc:  # Py4J wraps what the file system throws
        if path_exists(spark, path):
            return False
        raise exc
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read_note(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return "".join(chr(stream.read()) for _ in range(int(fs.getFileStatus(p).getLen())))
    finally:
        stream.close()


def write_batch(df: DataFrame, path: str, batch_id: int, replay: bool = True) -> None:
    """Write one batch folder.  ``replay``: replace what an earlier try of the same
    batch left; otherwise a number that is taken is an error and nothing is lost."""
    df.write.mode("overwrite" if replay else "errorifexists").parquet(f"{path}/batch_id={batch_id}")


def scan_rows(scored: DataFrame, batch_id: int, ts: Column | None = None) -> DataFrame:
    """S13 row shape from ``score_domains`` output."""
    return scored.select(
        batch_ids(batch_id).alias("id"),
        F.col("domain"),
        F.col("label"),
        F.col("confidence").cast("double"),
        (ts if ts is not None else F.current_timestamp()).alias("ts"),
        F.col("features"),
    )


def append_scans(scored: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append one scoring batch to the scan log, with its slice of the index."""
    from hostscope.sources.log_index import index_batch

    number = next_batch(scored.sparkSession, path) if batch_id is None else batch_id
    write_batch(scan_rows(scored, number), path, number, replay=batch_id is not None)
    index_batch(scored.sparkSession, path, number)


def read_scans(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The scan log (pruned to ``columns``); empty when absent."""
    if path_exists(spark, path):
        df = spark.read.schema(SCAN_SCHEMA).parquet(path)
    else:
        df = spark.createDataFrame([], SCAN_SCHEMA)
    return df.select(*(columns or [f.name for f in SCAN_SCHEMA.fields]))


def valid_correction(domain: Column, label: Column) -> Column:
    """Non-blank domain and one of the two classes."""
    return (F.length(py_strip(domain)) > 0) & label.isin(lists.LABELS)


def flip_label(label: Column) -> Column:
    """The other class."""
    return F.when(label == lists.PHISHING, F.lit(lists.LEGITIMATE)).otherwise(F.lit(lists.PHISHING))


def append_corrections(reports: DataFrame, path: str, batch_id: int | None = None) -> DataFrame:
    """L1 = P12 + S12: validate reports (``domain, corrected_label``), store
    the valid ones trimmed and lower-cased; returns the rejected rows."""
    ok = valid_correction(F.col("domain"), F.col("corrected_label"))
    number = next_batch(reports.sparkSession, path) if batch_id is None else batch_id
    good = reports.where(ok).select(
        batch_ids(number).alias("id"),
        F.lower(py_strip("domain")).alias("domain"),
        F.lower(py_strip("corrected_label")).alias("corrected_label"),
        F.current_timestamp().alias("ts"),
    )
    write_batch(good, path, number, replay=batch_id is not None)
    return reports.where(~ok | ok.isNull())


# ------------------------------------------------------------ service database

SERVICE_SCANS = "domain_scans"
SERVICE_REPORTS = "reported_mistakes"


def scans_from_service(df: DataFrame) -> DataFrame:
    """The service's scan table (id, domain, label, confidence, timestamp,
    features_json) in this library's log layout: ``ts`` and a typed
    ``features`` struct parsed from the JSON text."""
    return df.select(
        F.col("id").cast("long").alias("id"),
        F.col("domain").cast("string").alias("domain"),
        F.col("label").cast("string").alias("label"),
        F.col("confidence").cast("double").alias("confidence"),
        F.col("timestamp").cast("timestamp").alias("ts"),
        F.from_json(F.col("features_json").cast("string"), FEATURE_STRUCT).alias("features"),
    )


def reports_from_service(df: DataFrame) -> DataFrame:
    """The service's corrections table in this library's layout."""
    return df.select(
        F.col("id").cast("long").alias("id"),
        F.col("domain").cast("string").alias("domain"),
        F.col("corrected_label").cast("string").alias("corrected_label"),
        F.col("timestamp").cast("timestamp").alias("ts"),
    )


def read_service_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                       partitions: int = 64) -> DataFrame:
    """A service table over JDBC, read in ``partitions`` parallel ranges of
    ``id`` (bounds from one MIN/MAX query).  Needs the database's JDBC driver
    on the classpath."""
    props = dict(properties or {})
    bounds = spark.read.jdbc(url, f"(SELECT MIN(id) AS lo, MAX(id) AS hi FROM {table}) b", properties=props).first()
    if bounds is None or bounds["lo"] is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column="id", lowerBound=int(bounds["lo"]),
                           upperBound=int(bounds["hi"]) + 1, numPartitions=partitions, properties=props)


def import_service_log(spark: SparkSession, url: str, log_path: str, reports_path: str,
                       properties: dict | None = None, batch_id: int | None = None) -> None:
    """Copy the service's scan log and corrections into the Parquet tables, as one
    new batch each; a named batch is replaced on a re-run."""
    for table, shape, path in ((SERVICE_SCANS, scans_from_service, log_path),
                               (SERVICE_REPORTS, reports_from_service, reports_path)):
        number = next_batch(spark, path) if batch_id is None else batch_id
        write_batch(shape(read_service_table(spark, url, table, properties)), path, number, replay=batch_id is not None)

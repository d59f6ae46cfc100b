"""Ingest sources and sinks.

Readers return DataFrames with explicit schemas (no inference).  Order-
dependent steps downstream need a position, so feeds carry ``source_prio``
and ``pos``: the rank for ranked lists, and a file-order id for text/CSV
feeds (``monotonically_increasing_id`` grows with the file position inside a
file and with the partition index across splits of one file).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostscope.functions import lists
from hostscope.functions.urls import js_trim, netloc_app, netloc_notebook, py_strip
from hostscope.operators.dataset import keep_first, keep_last, union_all, unique_by

LABELLED_SCHEMA = "domain string, label string"


# ------------------------------------------------------------ filesystem


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a Hadoop-visible path exists (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def find_first(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """S7 helper: the first existing path of ``candidates``."""
    for c in candidates:
        if path_exists(spark, c):
            return c
    return None


# ------------------------------------------------------------ S1-S5


def _with_pos(df: DataFrame, prio: int) -> DataFrame:
    return df.withColumn("source_prio", F.lit(prio)).withColumn("pos", F.monotonically_increasing_id())


def read_text_feed(spark: SparkSession, path: str, prio: int = 1, notebook: bool = False) -> DataFrame:
    """Headerless one-URL-per-line feed -> domain, label=phishing.
    Read as a one-column CSV, as the source does: quotes are removed and
    blank lines skipped."""
    df = _with_pos(spark.read.schema("url STRING").csv(path), prio)
    host = netloc_notebook("url") if notebook else netloc_app("url")
    return df.select(host.alias("domain"), F.lit(lists.PHISHING).alias("label"), "source_prio", "pos")


def read_csv_feed(spark: SparkSession, path: str, prio: int = 2, url_col: str = "url",
                  notebook: bool = False) -> DataFrame:
    """S3: CSV feed with a header; only the URL column is read."""
    df = spark.read.option("header", True).csv(path).select(F.col(url_col).cast("string").alias("url"))
    df = _with_pos(df, prio)
    host = netloc_notebook("url") if notebook else netloc_app("url")
    return df.select(host.alias("domain"), F.lit(lists.PHISHING).alias("label"), "source_prio", "pos")


def read_ranked(spark: SparkSession, path: str, head: int = lists.RANKED_HEAD_APP, prio: int = 3) -> DataFrame:
    """S4 + O1: headerless ``rank,domain`` list, its first ``head`` rows whatever their
    numbers, legitimate.  The order is that of the file, by split and row; the head
    is kept per task, so the list is neither sorted nor collected as a whole."""
    df = spark.read.schema("rank INT, domain STRING").csv(path).select(
        "domain", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                           F.monotonically_increasing_id()).alias("place"))
    first = df.orderBy("place").limit(head)
    return first.select(
        "domain", F.lit(lists.LEGITIMATE).alias("label"), F.lit(prio).alias("source_prio"),
        F.row_number().over(Window.orderBy("place")).cast("long").alias("pos"),
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A combined ``domain,label`` set (CSV with header, or Parquet)."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema(LABELLED_SCHEMA).csv(path)
    return spark.read.parquet(path).select("domain", "label")


def write_labelled(df: DataFrame, path: str) -> None:
    """Persist the deduplicated set (before augmentation)."""
    df.select("domain", "label").write.mode("overwrite").parquet(path)


def combine_feeds(feeds: Sequence[DataFrame], notebook: bool = False) -> DataFrame:
    """A1 + P5 + P4 + D1 (+ P6 for the notebook): stack the feeds, drop nulls,
    strip (and lower, notebook), keep the first row per domain."""
    rows = union_all(feeds)
    d = py_strip("domain")
    if notebook:
        d = F.lower(d)
    # P5: rows whose domain is null are dropped by the dedupe itself (the
    # label is never null in a feed); P6 (notebook) drops the empty domain.
    rows = rows.withColumn("domain", d)
    empty = (F.length("domain") == 0) if notebook else None
    return keep_first(rows, "domain", ("source_prio", "pos"), drop_null_key=True, drop_if=empty)


# ------------------------------------------------------------ S7


def resolve_dataset(spark: SparkSession, base: str) -> DataFrame:
    """Raw feeds when all three exist, else the combined file, else error."""
    def cand(name):
        return [f"{base}/{name}", f"{base}/data/{name}"]

    text = find_first(spark, cand(lists.FEED_TEXT_FILE))
    csv1 = find_first(spark, cand(lists.FEED_CSV_FILE))
    csv2 = find_first(spark, cand(lists.FEED_CSV2_FILE))
    ranked = find_first(spark, cand(lists.RANKED_FILE))
    combined = find_first(spark, cand(lists.COMBINED_FILE)
                          + cand(lists.COMBINED_FILE.replace(".csv", ".parquet")))
    if csv2 and (text or csv1) and ranked:
        first = read_text_feed(spark, text, 1) if text else read_csv_feed(spark, csv1, 1)
        return combine_feeds([first, read_csv_feed(spark, csv2, 2), read_ranked(spark, ranked)]).select(
            "domain", "label"
        )
    if combined:
        # The combined file keeps the last row per domain (file order)
        rows = read_labelled(spark, combined).withColumn("pos", F.monotonically_increasing_id())
        return keep_last(rows, "domain", ("pos",)).select("domain", "label")
    raise FileNotFoundError(f"no raw feeds and no combined dataset under {base}")


# ------------------------------------------------------------ S8, S9


def read_feature_cache(spark: SparkSession, path: str | Sequence[str],
                       required: Sequence[str] = lists.FEATURE_ORDER):
    """The first existing cache of ``path`` (one path or candidates in
    order); used only if it has every model column (deduplicated by
    domain), else ``None`` (caller re-extracts)."""
    found = find_first(spark, [path] if isinstance(path, str) else list(path))
    if found is None:
        return None
    df = spark.read.parquet(found)
    if not set(required) <= set(df.columns):
        return None
    return unique_by(df, "domain")  # D4


def append_feature_cache(features: DataFrame, path: str) -> None:
    """Append rows (the caller passes only keys not yet cached)."""
    features.drop("label").write.mode("append").parquet(path)


# ------------------------------------------------------------ S10, S11


def curated_rows(spark: SparkSession) -> DataFrame:
    """The hand-written labelled rows added to every training set."""
    rows = [(d, lists.LEGITIMATE) for d in lists.CURATED_LEGITIMATE] + [
        (d, lists.PHISHING) for d in lists.CURATED_PHISHING
    ]
    return spark.createDataFrame(rows, LABELLED_SCHEMA)


def notebook_subdomains(spark: SparkSession, prio: int = 3) -> DataFrame:
    """S10 (notebook): known legitimate subdomains, after the ranked list."""
    rows = [(d, lists.LEGITIMATE, prio, i) for i, d in enumerate(lists.NOTEBOOK_SUBDOMAINS)]
    return spark.createDataFrame(rows, "domain string, label string, source_prio int, pos long")


CORRECTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("corrected_label", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """``domain, label (= corrected_label), ts, id``; empty if absent."""
    if path_exists(spark, path):
        df = spark.read.parquet(path)
    else:
        df = spark.createDataFrame([], CORRECTION_SCHEMA)
    return df.select("domain", F.col("corrected_label").alias("label"), "ts", "id")


# ------------------------------------------------------------ S16


def batch_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pasted text -> one trimmed, non-empty line per row, numbered
    from 1 within its text.  Whole texts are split; nothing is dropped but
    blank lines."""
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("i", "raw"))
    out = lines.select(id_col, (F.col("i") + 1).cast("long").alias("line_no"), js_trim("raw").alias("line"))
    return out.where(F.length("line") > 0)

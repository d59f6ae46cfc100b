"""Appends keep what is there; streams keep their offsets; A4 keeps two classes."""

from pyspark.sql import functions as F

from hostscope.operators import dataset as D
from hostscope.sources.tables import STREAM_BASE, append_corrections, batch_ids, next_batch, write_batch


def _reports(spark, name):
    return spark.createDataFrame([(name, "phishing")], "domain string, corrected_label string")


def test_unnamed_appends_keep_all_rows(spark, tmp_dir):
    path = f"{tmp_dir}/reports"
    for name in ("a.tk", "b.tk", "c.tk"):
        append_corrections(_reports(spark, name), path)
    out = spark.read.parquet(path)
    assert sorted(r.domain for r in out.collect()) == ["a.tk", "b.tk", "c.tk"]
    assert out.select("id").distinct().count() == 3


def test_wide_writes_do_not_share_ids(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    for _ in range(2):
        n = next_batch(spark, path)
        df = spark.range(3000).repartition(1500).select(batch_ids(n).alias("id"), F.col("id").alias("v"))
        write_batch(df, path, n, replay=False)
    out = spark.read.parquet(path)
    assert out.count() == 6000 and out.select("id").distinct().count() == 6000


def test_streams_do_not_take_numbers(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    write_batch(spark.range(3).select(batch_ids(STREAM_BASE + 4).alias("id")), path, STREAM_BASE + 4)
    assert next_batch(spark, path) == 0
    write_batch(spark.range(3).select(batch_ids(0).alias("id")), path, 0, replay=False)
    assert next_batch(spark, path) == 1 and spark.read.parquet(path).count() == 6


def test_balance_ignores_other_labels(spark):
    rows = [(i, "phishing") for i in range(20)] + [(i, "legitimate") for i in range(20, 30)] + [(99, "stray"), (100, None)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = {r.label: r.n for r in D.balance_downsample(df, F.col("id")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"phishing": 10, "legitimate": 10}

"""File sources (S1-S11), request operators (P11, P13) and the job CLI."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.operators.requests import EmptyBatchError, align_features, require_valid, split_valid
from hostscope.sources import feeds
from hostscope.sources.tables import append_corrections, read_scans


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def raw_dir(tmp_dir):
    _write(f"{tmp_dir}/data/{lists.FEED_TEXT_FILE}", "http://www.evil-login.tk/a\nhttps://paypal.com.verify.xyz/x\n")
    _write(f"{tmp_dir}/data/{lists.FEED_CSV2_FILE}",
           "phish_id,url\n1,http://evil-login.tk/b\n2,https://bad.example.top/\n3,https://google.com/phish\n")
    _write(f"{tmp_dir}/data/{lists.RANKED_FILE}", "1,google.com\n2,evil-login.tk\n3,wikipedia.org\n")
    return tmp_dir


def test_resolve_raw_feeds(spark, raw_dir):
    df = feeds.resolve_dataset(spark, raw_dir)
    got = dict(df.collect())
    assert got["evil-login.tk"] == "phishing"           # feed beats the ranked list
    assert got["google.com"] == "phishing"              # second feed beats the list
    assert got["wikipedia.org"] == "legitimate"
    assert got["paypal.com.verify.xyz"] == "phishing"


def test_resolve_combined_and_missing(spark, tmp_dir):
    _write(f"{tmp_dir}/{lists.COMBINED_FILE}",
           "domain,label\na.com,legitimate\nb.tk,phishing\na.com,phishing\n")
    got = dict(feeds.resolve_dataset(spark, tmp_dir).collect())
    assert got == {"a.com": "phishing", "b.tk": "phishing"}  # keep-last by file order
    with pytest.raises(FileNotFoundError):
        feeds.resolve_dataset(spark, f"{tmp_dir}/nothing")


def test_ranked_head(spark, tmp_dir):
    _write(f"{tmp_dir}/top.csv", "\n".join(f"{i},d{i}.com" for i in range(1, 11)))
    assert feeds.read_ranked(spark, f"{tmp_dir}/top.csv", head=4).count() == 4
    # the first rows count, not the numbers that stand in them
    _write(f"{tmp_dir}/gaps.csv", "\n".join(f"{i},d{i}.com" for i in (7, 3, 90, 12, 1)))
    got = feeds.read_ranked(spark, f"{tmp_dir}/gaps.csv", head=3).orderBy("pos").collect()
    assert [(r.domain, r.pos) for r in got] == [("d7.com", 1), ("d3.com", 2), ("d90.com", 3)]


def test_feature_cache_column_check(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    assert feeds.read_feature_cache(spark, path) is None
    spark.createDataFrame([("a.com", 1)], "domain string, length int").write.parquet(path)
    assert feeds.read_feature_cache(spark, path) is None  # columns missing -> re-extract
    assert feeds.read_feature_cache(spark, [f"{tmp_dir}/v3", path]) is None


def test_corrections_roundtrip(spark, tmp_dir):
    path = f"{tmp_dir}/corr"
    assert feeds.read_corrections(spark, path).count() == 0
    reports = spark.createDataFrame([("  Bad.TK ", "phishing"), ("", "phishing"), ("x.com", "spam")],
                                    "domain string, corrected_label string")
    rejected = append_corrections(reports, path, batch_id=1)
    assert rejected.count() == 2
    got = feeds.read_corrections(spark, path).collect()
    assert [(r["domain"], r["label"]) for r in got] == [("bad.tk", "phishing")]
    append_corrections(reports, path, batch_id=1)  # replay: same partition, no duplicate
    assert feeds.read_corrections(spark, path).count() == 1


def test_batch_validation(spark):
    df = spark.createDataFrame([("google.com",), ("dfsdf",), ("   ",)], "domain string")
    ok, bad = split_valid(df)
    assert [r[0] for r in ok.collect()] == ["google.com"]
    assert sorted(r["reason"] for r in bad.collect()) == ["empty", "invalid"]
    with pytest.raises(EmptyBatchError):
        require_valid(spark.createDataFrame([("dfsdf",), ("12345",)], "domain string"))
    with pytest.raises(EmptyBatchError):
        require_valid(spark.createDataFrame([], "domain string"))


def test_align_features(spark):
    df = spark.createDataFrame([(1, 5, 2)], "id int, length int, brand_match int")
    out = align_features(df, lists.FEATURE_ORDER, keep=["id"])
    assert out.columns == ["id", *lists.FEATURE_ORDER]
    r = out.first()
    assert r["length"] == 5 and r["brand_match"] == 2 and r["entropy"] == 0


def test_jobs_cli(spark, raw_dir, tmp_dir, capsys):
    from hostscope import jobs

    model = f"{tmp_dir}/model"
    jobs.main(["train", "--data", raw_dir, "--model", model, "--cache", f"{tmp_dir}/cache", "--trees", "3",
               "--write-combined", f"{tmp_dir}/combined"])
    assert feeds.read_labelled(spark, f"{tmp_dir}/combined").count() == 5
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert "test" in out["metrics"]
    _write(f"{tmp_dir}/in/batch.txt", "google.com\nbad-login.tk\ndfsdf\n")
    jobs.main(["score", "--model", model, "--input", f"{tmp_dir}/in", "--log", f"{tmp_dir}/log", "--batch-id", "7"])
    capsys.readouterr()
    assert read_scans(spark, f"{tmp_dir}/log").count() == 2
    jobs.main(["stats", "--log", f"{tmp_dir}/log"])
    st = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert st["share"]["total_scanned"] == 2
    assert F is not None


def test_write_and_read_labelled(spark, tmp_dir):
    df = spark.createDataFrame([("a.com", "legitimate", 1)], "domain string, label string, extra int")
    feeds.write_labelled(df, f"{tmp_dir}/combined")
    back = feeds.read_labelled(spark, f"{tmp_dir}/combined")
    assert back.columns == ["domain", "label"] and back.count() == 1


def test_size_shuffles(spark, tmp_dir):
    from hostscope.session import input_bytes, size_shuffles

    _write(f"{tmp_dir}/x/a.txt", "a" * 1000)
    assert input_bytes(spark, [f"{tmp_dir}/x", f"{tmp_dir}/missing"]) == 1000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 100 * 2**40) == 400_000      # 100 TB -> 256 MB partitions
        assert size_shuffles(spark, 10 * 2**30) == 200           # small input: floor
        assert size_shuffles(spark, 1000 * 2**30) == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", old)


def test_batch_ids_unique_and_replay_safe(spark, tmp_dir):
    from pyspark.sql import functions as F

    from hostscope.sources.tables import batch_ids, write_batch

    path = f"{tmp_dir}/t"
    df = spark.range(0, 5000, numPartitions=7).select(F.col("id").alias("v"))
    write_batch(df.select("v", batch_ids(3).alias("id")), path, 3)
    write_batch(df.select("v", batch_ids(4).alias("id")), path, 4)
    write_batch(df.select("v", batch_ids(4).alias("id")), path, 4)  # replay of batch 4
    out = spark.read.parquet(path)
    assert out.count() == 10000
    assert out.select("id").distinct().count() == 10000
    b3 = out.where("batch_id = 3").agg(F.max("id")).first()[0]
    b4 = out.where("batch_id = 4").agg(F.min("id")).first()[0]
    assert b3 < b4


def test_text_feed_reads_like_csv(spark, tmp_dir):
    _write(f"{tmp_dir}/feed.txt", 'http://a.tk/x\n\n"https://www.b.xyz/login"\nhttp://c.top\n')
    got = [r["domain"] for r in feeds.read_text_feed(spark, f"{tmp_dir}/feed.txt").orderBy("pos").collect()]
    assert got == ["a.tk", "b.xyz", "c.top"]


def test_shared_paths_live_under_checkpoint_dir(spark):
    from hostscope.session import ensure_checkpoint_dir, shared_path

    base = ensure_checkpoint_dir(spark)
    assert base and spark.sparkContext.getCheckpointDir()
    a, b = shared_path(spark, "streams", "x"), shared_path(spark, "streams", "x")
    assert a.startswith(base) and b.startswith(base) and a != b


def test_service_tables_convert(spark):
    from hostscope.operators.scanlog import scan_history
    from hostscope.sources.tables import reports_from_service, scans_from_service

    scans = spark.createDataFrame(
        [(1, "legit1.com", "legitimate", 0.95, "2024-01-01 10:00:00", '{"length": 10, "tld": "com", "entropy": 2.5}'),
         (2, "phish1.tk", "phishing", 0.88, "2024-01-01 11:00:00", "{}")],
        "id int, domain string, label string, confidence float, timestamp string, features_json string")
    log = scans_from_service(scans)
    rows = {r["id"]: r for r in log.collect()}
    assert rows[1]["features"]["length"] == 10 and rows[1]["features"]["tld"] == "com"
    assert rows[2]["features"]["length"] is None
    assert [r["id"] for r in scan_history(log, 10).collect()] == [2, 1]
    reps = reports_from_service(spark.createDataFrame(
        [(7, "x.tk", "phishing", "2024-01-02 00:00:00")], "id int, domain string, corrected_label string, timestamp string"))
    assert reps.columns == ["id", "domain", "corrected_label", "ts"]

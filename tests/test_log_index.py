"""Slices of the scan log: replaced batches count once, old batches stay closed."""

import os

import pytest
from pyspark.sql import functions as F

from hostscope.operators.scanlog import class_share, scan_history, share_of, stats_document
from hostscope.sources.log_index import index_path, indexed_history, indexed_stats, log_sums, newest_batches, refresh_index
from hostscope.sources.tables import SCAN_SCHEMA, read_scans, write_batch

ROWS = "id long, domain string, label string, confidence double, ts string"


def _write(spark, log, batch, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("ts", F.to_timestamp("ts"))
    df = df.withColumn("features", F.lit(None).cast(SCAN_SCHEMA["features"].dataType))
    write_batch(df.select(*SCAN_SCHEMA.names), log, batch)


def _scan(i, day, label="phishing", domain=None):
    return (i, domain or f"d{i % 5}.t{i % 3}", label, 0.5, f"2024-01-{day:02d} 00:00:{i % 60:02d}" if day else None)


@pytest.fixture
def log(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    for b in range(6):
        _write(spark, path, b, [_scan(b * 100 + i, b + 1, "phishing" if i % 3 else "legitimate") for i in range(20)])
    return path


def _doc(df):
    r = df.first()
    return r.total_scanned, dict(r.label_counts), [tuple(t) for t in r.top_risky_tlds]


def test_sums_equal_a_scan_of_the_log(spark, log):
    assert refresh_index(spark, log) == [0, 1, 2, 3, 4, 5]
    assert refresh_index(spark, log) == []
    assert _doc(indexed_stats(spark, log)) == _doc(stats_document(read_scans(spark, log)))
    assert share_of(log_sums(spark, log)).first() == class_share(read_scans(spark, log)).first()


def test_replaced_and_removed_batches(spark, log):
    refresh_index(spark, log)
    _write(spark, log, 2, [_scan(200, 3, "phishing", "new.zz")])  # a replay with other rows
    _write(spark, log, 9, [_scan(900, 9, "other", "x.y"), _scan(901, 9, None, "no dot")])
    assert refresh_index(spark, log) == [2, 9]
    got = _doc(indexed_stats(spark, log))
    assert got == _doc(stats_document(read_scans(spark, log))) and got[0] == 103 and got[1]["other"] == 1
    from hostscope.session import remove_path

    remove_path(spark, f"{log}/batch_id=9")
    assert refresh_index(spark, log) == [] and not os.path.exists(f"{index_path(log)}/batch_id=9")
    assert _doc(indexed_stats(spark, log))[0] == 101


def test_history_leaves_old_batches_closed(spark, log):
    want = [r.id for r in scan_history(read_scans(spark, log), 25).collect()]
    assert newest_batches(spark, log, 25) == [4, 5]
    for b in range(4):  # whoever opens these fails
        for f in os.listdir(f"{log}/batch_id={b}"):
            if f.endswith(".parquet"):
                with open(f"{log}/batch_id={b}/{f}", "wb") as out:
                    out.write(b"not parquet")
    assert [r.id for r in indexed_history(spark, log, 25).collect()] == want


def test_history_with_ties_and_overlaps(spark, log):
    _write(spark, log, 7, [_scan(7, 6), _scan(701, 1), _scan(702, None), _scan(519, 6)])  # newest row ties with batch 5
    for limit in (1, 3, 25, 60, 500):
        want = [r.id for r in scan_history(read_scans(spark, log), limit).collect()]
        assert [r.id for r in indexed_history(spark, log, limit).collect()] == want, limit


def test_empty_and_missing_logs(spark, tmp_dir):
    path = os.path.join(tmp_dir, "none")
    assert indexed_history(spark, path).count() == 0
    assert _doc(indexed_stats(spark, path)) == (0, {"legitimate": 0, "phishing": 0}, [])
    _write(spark, path, 0, [])
    assert indexed_history(spark, path).count() == 0
    assert _doc(indexed_stats(spark, path))[0] == 0


def test_stream_counts_a_replayed_batch_once(spark, log, tmp_dir):
    from hostscope.streaming.scoring import start_stats

    out, cp = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "cp")

    def run():
        q, _ = start_stats(spark, log, checkpoint=cp, out_path=out)
        q.processAllAvailable()
        q.stop()
        return dict(spark.read.parquet(f"{out}/labels").collect())

    first = run()
    assert sum(first.values()) == 120
    _write(spark, log, 3, [_scan(300 + i, 4, "phishing" if i % 3 else "legitimate") for i in range(20)])  # replayed as it was
    assert run() == first
    got = spark.read.parquet(f"{out}/tlds").orderBy(F.desc("count"), "first_id").limit(5).collect()
    assert [(r.tld, r["count"]) for r in got] == _doc(stats_document(read_scans(spark, log)))[2]


def test_two_imports_keep_both(spark, tmp_dir, monkeypatch):
    """``import-service`` without a number appends; it never replaces a batch."""
    from hostscope import jobs
    from hostscope.sources import tables

    service = {
        tables.SERVICE_SCANS: spark.createDataFrame(
            [(1, "a.tk", "phishing", 0.9, "2024-01-01 00:00:00", "{}")],
            "id int, domain string, label string, confidence float, timestamp string, features_json string"),
        tables.SERVICE_REPORTS: spark.createDataFrame(
            [(1, "a.tk", "phishing", "2024-01-02 00:00:00")], "id int, domain string, corrected_label string, timestamp string")}
    monkeypatch.setattr(tables, "read_service_table", lambda _spark, _url, table, _props=None: service[table])
    log, reports = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "reports")
    _write(spark, log, 0, [_scan(5, 1)])
    for _ in range(2):
        jobs.main(["import-service", "--url", "jdbc:none", "--log", log, "--reports", reports])
    assert sorted(r.id for r in read_scans(spark, log).collect()) == [1, 1, 5]
    assert spark.read.parquet(reports).count() == 2

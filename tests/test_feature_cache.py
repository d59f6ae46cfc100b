"""The keyed feature cache: joins leave it where it lies, a domain has one row."""

import os
import re

import pytest
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.operators.features import with_host_features
from hostscope.operators.training import features_with_cache
from hostscope.sources import feature_cache as fc


def _domains(spark, names):
    return spark.createDataFrame([(n,) for n in names], "domain string")


def _features(df):
    return with_host_features(df, "domain")


@pytest.fixture
def cache(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cache")
    fc.create_cache(_features(_domains(spark, ["a.com", "b.tk", "a.com", None])), path, buckets=4)
    return path


def _names(spark, path):
    return sorted(r.domain for r in fc.open_cache(spark, path).select("domain").collect())


def test_one_row_a_domain(spark, cache):
    assert _names(spark, cache) == ["a.com", "b.tk"]
    for _ in range(2):
        fc.upsert(spark, _domains(spark, ["b.tk", "c.org", "c.org", "d.net", None]), cache, _features)
    assert _names(spark, cache) == ["a.com", "b.tk", "c.org", "d.net"]
    want = {r.domain: r for r in _features(_domains(spark, ["a.com", "c.org"])).collect()}
    got = {r.domain: r for r in fc.open_cache(spark, cache).collect()}
    assert all(got[d].asDict() == r.asDict() for d, r in want.items())


def test_only_missing_domains_are_extracted(spark, cache):
    seen = []

    def extract(d):
        seen.extend(r.domain for r in d.collect())
        return _features(d)

    fc.upsert(spark, _domains(spark, ["a.com", "z.io", "z.io"]), cache, extract)
    assert seen == ["z.io"]


def test_another_session_finds_the_buckets(spark, cache):
    spark.sql(f"DROP TABLE {fc._name(cache)}")  # external: the files stay
    fc.upsert(spark, _domains(spark, ["e.app"]), cache, _features)
    assert _names(spark, cache) == ["a.com", "b.tk", "e.app"]


def _exchanges_above_cache(df):
    """Exchange nodes between the bucketed scan and the root of its join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:|]*(?:\+- )?", line).group())
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and re.search(r"Bucketed: true", x))
    level, found = depth(lines[scan]), []
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            if "Join" in line:
                break
            found.append(line)
    return [x for x in found if "Exchange" in x]


def test_joins_do_not_shuffle_the_cache(spark, cache):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = _domains(spark, ["a.com", "x.y"]).withColumn("label", F.lit("phishing"))
        assert _exchanges_above_cache(fc.missing_domains(spark, rows, cache)) == []  # J2
        joined = rows.join(fc.open_cache(spark, cache), "domain", "left")  # J1
        assert _exchanges_above_cache(joined) == []
        assert {r.domain: r.length for r in joined.collect()} == {"a.com": 5, "x.y": None}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_missing_plain_and_incomplete_caches(spark, tmp_dir):
    path = os.path.join(tmp_dir, "c")
    assert fc.open_cache(spark, path) is None
    _domains(spark, ["a.com"]).withColumn("length", F.lit(1)).write.parquet(path)  # columns missing
    out = features_with_cache(spark, _domains(spark, ["a.com", "q.de"]), path)
    assert sorted(r.domain for r in out.collect()) == ["a.com", "q.de"] and fc.is_keyed(spark, path)
    plain = os.path.join(tmp_dir, "plain")
    _features(_domains(spark, ["a.com"])).write.parquet(plain)  # an older, unkeyed cache
    out = features_with_cache(spark, _domains(spark, ["a.com", "r.ru"]), plain)
    assert sorted(r.domain for r in out.collect()) == ["a.com", "r.ru"] and set(lists.FEATURE_ORDER) <= set(out.columns)


def test_empty_cache(spark, tmp_dir):
    path = os.path.join(tmp_dir, "empty")
    fc.create_cache(_features(_domains(spark, [])), path, buckets=2)
    fc.upsert(spark, _domains(spark, ["a.com"]), path, _features)
    assert _names(spark, path) == ["a.com"]

"""Driver contract: entry() smoke, and every registered query vs DuckDB."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from oracle_check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert "entropy" in df.columns and "tld" in df.columns


def _duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


import __spark_entry__ as _e  # noqa: E402

NAMES = sorted(n for n in _e.oracle_sql() if not n.startswith("op") and n != "pipeline")
SQL = _e.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return _duck()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = _e.queries()[name](spark, SF)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(SQL[name])
    b, bc = rows_of([d[0] for d in res.description], res.fetchall())
    assert ac == bc
    assert a == b


def test_every_query_has_oracle_or_is_model_backed():
    q, o = _e.queries(), _e.oracle_sql()
    own = {n for n in q if not n.startswith("op") and n != "pipeline"}
    assert own - set(o) == {"score_domains", "feature_importance"}


def test_catalogue_needs_no_spark_jar(monkeypatch):
    """Queries and oracle texts come from the package alone."""
    import zipfile

    from hostscope.sources import suffix_list

    def closed(*_a, **_k):
        raise FileNotFoundError("jars are hidden")

    monkeypatch.setattr(zipfile, "ZipFile", closed)
    suffix_list._rows_for.cache_clear()
    assert len(suffix_list.suffix_rule_rows()) > 5_000
    assert all("{{" not in sql for sql in _e.oracle_sql().values())


def test_bench_prints_one_json_line():
    import json
    import subprocess

    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "scan_stats", "host_clean"],
                         capture_output=True, text=True, env=env, timeout=600, cwd=ROOT)
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1, out.stdout
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and set(d["queries"]) == {"scan_stats", "host_clean"} and "errors" not in d

"""Several writers on one log: numbers are claimed once and found again."""

import os

from pyspark.sql import functions as F

from hostscope.operators.features import with_host_features
from hostscope.operators.model import TreeSettings, fit
from hostscope.plans.derived import spark_labelled
from hostscope.sources.tables import STREAM_BASE, claim_number, read_scans
from hostscope.streaming.scoring import start_scoring


def test_claims(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log")
    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    got = [claim_number(spark, log, who, n) for n in range(3) for who in (a, b)]
    assert got == list(range(STREAM_BASE, STREAM_BASE + 6))
    assert [claim_number(spark, log, who, n) for n in range(3) for who in (a, b)] == got  # a replay


def test_two_streams_on_one_log(spark, tmp_dir):
    model = fit(with_host_features(spark_labelled(spark, "/root/testdata/sf0.001"), "domain"),
                TreeSettings(trees=2, depth=2, method="histogram"))
    log, want = os.path.join(tmp_dir, "log"), []
    for turn in range(2):  # the second turn restarts both
        queries = []
        for name in ("one", "two"):
            source = os.path.join(tmp_dir, name)
            os.makedirs(source, exist_ok=True)
            want.append(f"{name}{turn}.com")
            with open(os.path.join(source, f"{turn}.txt"), "w") as f:
                f.write(want[-1] + "\n")
            queries.append(start_scoring(spark, source, model, log, name=name))
        for q in queries:
            q.processAllAvailable()
            q.stop()
    rows = read_scans(spark, log).select("id", "domain").collect()
    assert sorted(r.domain for r in rows) == sorted(want)
    assert len({r.id for r in rows}) == 4
    assert read_scans(spark, log).agg(F.min("id")).first()[0] >= STREAM_BASE << 43

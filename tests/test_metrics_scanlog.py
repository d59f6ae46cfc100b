"""Metrics (golden matrix from the published results) and scan-log queries."""

import math
import random

from pyspark.sql import functions as F

from hostscope.operators import metrics as M
from hostscope.operators import scanlog as S


def _preds(spark):
    # 4750 TN, 135 FP, 636 FN, 4248 TP (the published test matrix)
    rows = [(0, 0)] * 4750 + [(0, 1)] * 135 + [(1, 0)] * 636 + [(1, 1)] * 4248
    rnd = random.Random(7)
    data = [(y, p, min(max((0.7 if p else 0.3) + rnd.uniform(-0.3, 0.3), 0.0), 1.0), rnd.randint(0, 1))
            for y, p in rows]
    return spark.createDataFrame(data, "y int, pred int, prob double, brand_match int"), data


def test_golden_matrix(spark):
    df, _ = _preds(spark)
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 4750, (0, 1): 135, (1, 0): 636, (1, 1): 4248}
    w = M.weighted_metrics(df).first()
    assert w["n"] == 9769
    assert round(w["accuracy"], 4) == 0.9211
    assert round(w["precision_weighted"], 4) == 0.9256
    assert round(w["recall_weighted"], 4) == 0.9211
    assert round(w["f1_weighted"], 4) == 0.9209
    rep = {r["label"]: r for r in M.class_metrics(df).collect()}
    assert rep["phishing"]["support"] == 4884 and rep["legitimate"]["support"] == 4885
    assert round(rep["weighted avg"]["f1"], 4) == 0.9209


def test_auc_exact(spark):
    df, data = _preds(spark)
    got = M.roc_auc(df, partitions=5).first()["auc"]
    pos = [p for y, _, p, _ in data if y == 1]
    neg = [p for y, _, p, _ in data if y == 0]
    # rank formula with average ranks for ties
    allp = sorted((p, y) for y, _, p, _ in data)
    ranks, i = {}, 0
    while i < len(allp):
        j = i
        while j < len(allp) and allp[j][0] == allp[i][0]:
            j += 1
        ranks[allp[i][0]] = (i + 1 + j) / 2.0
        i = j
    rsum = sum(ranks[p] for p in pos)
    exp = (rsum - len(pos) * (len(pos) + 1) / 2) / (len(pos) * len(neg))
    assert math.isclose(got, exp, rel_tol=1e-12)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector

    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0)
    raw = df.select(F.col("y").cast("double"), array_to_vector(F.array(1 - F.col("prob"), F.col("prob"))).alias("raw"))
    assert math.isclose(ev.evaluate(raw), exp, rel_tol=1e-9)


def test_sliced_accuracy(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1), (0, 1, 0.6, 1), (0, 0, 0.1, 0)], "y int, pred int, prob double, brand_match int")
    r = M.sliced_accuracy(df).first()
    assert (r["n"], r["accuracy"], r["above_floor"], r["note"]) == (2, 0.5, False, "ok")
    empty = M.sliced_accuracy(df.where("brand_match = 5")).first()
    assert empty["note"] == "no samples" and empty["n"] == 0


def _log(spark, rows):
    return spark.createDataFrame(
        rows, "id long, domain string, label string, confidence double, ts timestamp"
    )


def test_stats_reference_case(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [(1, "legit1.com", "legitimate", 0.95, t), (2, "phish1.tk", "phishing", 0.88, t),
                       (3, "phish2.tk", "phishing", 0.92, t)])
    s = S.scan_stats(log).first()
    assert (s["total_scanned"], s["legitimate"], s["phishing"]) == (3, 1, 2)
    top = S.top_risky_tlds(log).collect()
    assert [(r["tld"], r["count"], r["bar_pct"]) for r in top] == [("tk", 2, 100)]
    hist = S.scan_history(log, limit=10).collect()
    assert len(hist) == 3 and [r["id"] for r in hist] == [3, 2, 1]
    assert hist[0]["triggered"] == "tld_is_risky" and hist[2]["triggered"] == "none"
    assert hist[0]["confidence_pct"] == 92


def test_empty_log_shares(spark):
    log = _log(spark, [])
    r = S.class_share(log).first()
    assert (r["total_scanned"], r["legitimate"], r["phishing"], r["legitimate_pct"], r["phishing_pct"]) == (0, 0, 0, 50, 50)
    assert dict(S.label_counts(log).collect()) == {"legitimate": 0, "phishing": 0}


def test_top_tld_ties_first_seen_and_raw_domain(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(i, d, "phishing", 0.9, t) for i, d in enumerate(
        ["a.xyz", "b.top", "c.top", "d.xyz", "http://bad.tk/login", "nodot", "e.cc", "f.ml", "g.gq", "h.cf"])]
    top = S.top_risky_tlds(_log(spark, rows)).collect()
    assert [r["tld"] for r in top] == ["xyz", "top", "tk/login", "cc", "ml"]
    clean = S.top_risky_tlds(_log(spark, rows), clean_first=True).collect()
    assert "tk" in [r["tld"] for r in clean]


def test_stats_document(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    log = _log(spark, [(1, "legit1.com", "legitimate", 0.95, t), (2, "phish1.tk", "phishing", 0.88, t),
                       (3, "phish2.tk", "phishing", 0.92, t)])
    r = S.stats_document(log).first()
    assert r["total_scanned"] == 3
    assert r["label_counts"] == {"legitimate": 1, "phishing": 2}
    assert [(x["tld"], x["count"]) for x in r["top_risky_tlds"]] == [("tk", 2)]
    e = S.stats_document(_log(spark, [])).first()
    assert e["total_scanned"] == 0 and e["label_counts"] == {"legitimate": 0, "phishing": 0}
    assert e["top_risky_tlds"] == []

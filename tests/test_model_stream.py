"""Model training/scoring/saving, the training job, and streaming scoring."""

import os
import time

from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.operators.features import with_host_features
from hostscope.operators.model import (
    TreeSettings,
    feature_importance,
    fit,
    load_model,
    save_model,
    score_domains,
)
from hostscope.operators.training import train_job
from hostscope.plans.derived import spark_labelled

SF = "/root/testdata/sf0.01"
SMALL = TreeSettings(trees=8, depth=4)


def _model(spark):
    lab = spark_labelled(spark, SF)
    return fit(with_host_features(lab, "domain"), SMALL)


def test_score_override_and_roundtrip(spark, tmp_dir):
    model = _model(spark)
    df = spark.createDataFrame([("docs.google.com",), ("paypal-secure-update.com",), ("google.com",)], "domain string")
    out = {r["domain"]: r for r in score_domains(df, model).collect()}
    assert out["docs.google.com"]["label"] == "legitimate" and out["docs.google.com"]["confidence"] == 1.0
    assert out["paypal-secure-update.com"]["label"] == "phishing"  # not overridden, and learnt
    assert out["google.com"]["domain"] == "google.com"
    for r in out.values():
        assert r["label"] in lists.LABELS and 0.0 <= r["confidence"] <= 1.0
        assert set(r["features"].asDict()) >= set(lists.FEATURE_ORDER)
        assert set(r["additional_indicators"].asDict()) == {"is_ip", "has_mixed_script", "tld_is_risky"}
    path = os.path.join(tmp_dir, "model")
    save_model(model, path)
    again = load_model(path)
    a = [r["confidence"] for r in score_domains(df, model).orderBy("domain").collect()]
    b = [r["confidence"] for r in score_domains(df, again).orderBy("domain").collect()]
    assert a == b
    imp = feature_importance(model).collect()
    assert len(imp) == 23 and abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6


def test_model_learns(spark):
    model = _model(spark)
    lab = spark_labelled(spark, SF)
    scored = score_domains(lab.select("domain", F.col("label").alias("truth")), model)
    acc = scored.select(F.avg((F.col("label") == F.col("truth")).cast("double"))).first()[0]
    assert acc > 0.7


def test_train_job_with_cache(spark, tmp_dir):
    lab = spark_labelled(spark, "/root/testdata/sf0.001").select("domain", "label")
    corr = spark.createDataFrame([(1, "x-login.tk", "phishing", 1)], "id long, domain string, label string, ts long")
    cache = os.path.join(tmp_dir, "cache")
    res = train_job(spark, lab, corr, cache_path=cache, model_path=os.path.join(tmp_dir, "m"),
                    settings=TreeSettings(trees=5, depth=3))
    assert set(res.metrics) == {"valid", "test"}
    n_cache = spark.read.parquet(cache).count()
    # a second run only appends domains the cache lacks
    res2 = train_job(spark, lab, corr, cache_path=cache, settings=TreeSettings(trees=3, depth=3))
    assert spark.read.parquet(cache).count() == n_cache
    assert len(res2.importances) == 23
    cm = res.metrics["test"]["confusion"]
    assert sum(r["n"] for r in cm) > 0


def test_streaming_scoring_and_stats(spark, tmp_dir):
    from hostscope.streaming.scoring import running_label_counts, start_scoring, start_stats

    model = _model(spark)
    src = os.path.join(tmp_dir, "in")
    log = os.path.join(tmp_dir, "log")
    rej = os.path.join(tmp_dir, "rej")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("google.com\n\n  bad-login.tk \ndfsdf\nhttp://docs.google.com/x\n")
    q = start_scoring(spark, src, model, log, reject_path=rej, checkpoint=os.path.join(tmp_dir, "ck"))
    q.processAllAvailable()
    with open(os.path.join(src, "b.txt"), "w") as f:
        f.write("secure-paypal-login.xyz\n")
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(log).collect()
    assert sorted(r["domain"] for r in rows) == ["bad-login.tk", "google.com", "http://docs.google.com/x",
                                                 "secure-paypal-login.xyz"]
    assert len({r["id"] for r in rows}) == 4
    assert [r["domain"] for r in spark.read.parquet(rej).collect()] == ["dfsdf"]
    q1, q2 = start_stats(spark, log, name=f"t{int(time.time())}", checkpoint=os.path.join(tmp_dir, "ck2"))
    q1.processAllAvailable()
    q2.processAllAvailable()
    total = spark.sql(f"SELECT sum(n) FROM {q1.name}").first()[0]
    q1.stop()
    q2.stop()
    assert total == 4
    assert running_label_counts is not None


def test_notebook_variant_with_weights(spark, tmp_dir):
    lab = spark_labelled(spark, "/root/testdata/sf0.001").select("domain", "label")
    res = train_job(spark, lab, None, settings=TreeSettings.notebook(trees=3, depth=3))
    names = [f for f, _ in res.importances]
    assert sorted(names) == sorted(lists.NOTEBOOK_FEATURES)
    assert res.model.stages[-1].getWeightCol() == "weight"
    nb = train_job(spark, lab, variant="notebook", settings=TreeSettings.notebook(trees=3, depth=3))
    assert sorted(f for f, _ in nb.importances) == sorted(lists.NOTEBOOK_FEATURES)
    assert set(nb.metrics) == {"valid", "test"}


def test_weighted_dataset_mode(spark):
    from hostscope.operators.training import build_dataset

    lab = spark_labelled(spark, "/root/testdata/sf0.001").select("domain", "label")
    copies = build_dataset(spark, lab, None, copies=500).count()
    weighted = build_dataset(spark, lab, None, copies=500, weighted=True)
    assert copies == lab.count() + 14 * 500
    assert weighted.count() == lab.count() + 14
    assert weighted.agg(F.sum("weight")).first()[0] == lab.count() + 14 * 500


def test_training_is_deterministic_and_auc_floor(spark):
    from hostscope.operators import dataset as D
    from hostscope.operators import metrics as M
    from hostscope.operators.model import predict

    lab = spark_labelled(spark, SF)
    rows = D.stratified_split(lab, F.col("id"))
    feats = with_host_features(rows, "domain")
    train = feats.where(F.col("split") == "train")
    s = TreeSettings(trees=6, depth=4)
    a = [r["importance"] for r in feature_importance(fit(train, s)).orderBy("feature").collect()]
    m = fit(train, s)
    b = [r["importance"] for r in feature_importance(m).orderBy("feature").collect()]
    assert a == b
    test = predict(m, feats.where(F.col("split") == "test")).select(
        F.when(F.col("label") == "phishing", 1).otherwise(0).alias("y"), F.col("pred_idx").alias("pred"), "prob")
    assert M.roc_auc(test).first()["auc"] > 0.75


def test_scoring_keeps_a_given_label(spark):
    model = _model(spark)
    df = spark.createDataFrame([("google.com", "weird-class")], "domain string, label string")
    r = score_domains(df, model).first()
    assert r["given_label"] == "weird-class" and r["label"] == "legitimate"


def test_stats_stream_to_tables(spark, tmp_dir):
    from hostscope.sources.tables import write_batch
    from hostscope.streaming.scoring import start_stats

    log = os.path.join(tmp_dir, "log")
    rows = spark.createDataFrame(
        [(1, "a.tk", "phishing", 0.9, None, None), (2, "b.tk", "phishing", 0.8, None, None),
         (3, "c.com", "legitimate", 0.7, None, None)],
        "id long, domain string, label string, confidence double, ts timestamp, "
        "features struct<length:int>",
    ).drop("features")
    write_batch(rows, log, 0)
    out = os.path.join(tmp_dir, "stats")
    q1, q2 = start_stats(spark, log, checkpoint=os.path.join(tmp_dir, "ck"), out_path=out)
    q1.processAllAvailable()
    q2.processAllAvailable()
    q1.stop()
    q2.stop()
    assert dict(spark.read.parquet(f"{out}/labels").collect()) == {"phishing": 2, "legitimate": 1}
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{out}/tlds").collect()] == [("tk", 2)]

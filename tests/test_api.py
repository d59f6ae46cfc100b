"""Per-request helpers: the reference's inference / service / API cases."""

import os

import pytest

from hostscope import api
from hostscope.operators.features import with_host_features
from hostscope.operators.model import TreeSettings, fit
from hostscope.operators.requests import EmptyBatchError
from hostscope.plans.derived import spark_labelled
from hostscope.sources.tables import read_scans


@pytest.fixture(scope="module")
def model(spark):
    lab = spark_labelled(spark, "/root/testdata/sf0.01")
    return fit(with_host_features(lab, "domain"), TreeSettings(trees=6, depth=4))


def test_features_and_indicators(spark):
    f = api.extract_features(spark, "https://verify-login-paypal.com/signin")
    assert (f["length"], f["subdomain_count"], f["has_login"], f["has_verify"], f["tld"]) == (23, 0, 1, 1, "com")
    ind = api.additional_indicators(spark, "gооgle.com")
    assert ind == {"is_ip": False, "has_mixed_script": True, "tld_is_risky": False}
    assert api.is_valid(spark, "google.com") and not api.is_valid(spark, "dfsdf")
    assert api.is_valid(spark, "192.168.1.300") and not api.is_valid(spark, "192.168.1.300", client=True)


def test_inference_alignment_and_override(spark, model):
    r = api.predict_domain(spark, model, "google.com")
    assert r["domain"] == "google.com" and "label" in r and "confidence" in r
    docs = api.predict_domain(spark, model, "docs.google.com")
    assert docs["label"] == "legitimate" and docs["confidence"] == 1.0
    assert set(r["features"]) >= {"length", "entropy", "tld", "brand_match"}


def test_single_and_batch_then_stats_and_history(spark, model, tmp_dir):
    log = os.path.join(tmp_dir, "log")
    api.predict_batch(spark, model, ["paypal-secure-update.com"], log, batch_id=1)
    out = api.predict_batch(spark, model, ["microsoft.com", "secure-netflix-login.cam", "dfsdf"], log, batch_id=2)
    assert [r["domain"] for r in out.collect()] == ["microsoft.com", "secure-netflix-login.cam"]
    scans = read_scans(spark, log)
    assert scans.count() == 3
    st = api.aggregate_stats(scans)
    assert st["total_scanned"] == 3
    assert set(st["label_counts"]) == {"legitimate", "phishing"}
    assert sum(st["label_counts"].values()) == 3
    hist = api.history(scans, limit=10)
    assert len(hist) == 3 and all("triggered" in h for h in hist)
    assert set(hist[0]) >= {"domain", "label", "confidence", "timestamp", "features", "additional_indicators"}
    assert set(hist[0]["additional_indicators"]) == {"is_ip", "has_mixed_script", "tld_is_risky"}
    with pytest.raises(EmptyBatchError):
        api.predict_batch(spark, model, ["dfsdf", "12345"])
    with pytest.raises(EmptyBatchError):
        api.predict_batch(spark, model, [])


def test_request_validation_and_reports(spark, model, tmp_dir):
    from hostscope.sources.feeds import read_corrections

    with pytest.raises(api.InvalidInput, match="empty input"):
        api.predict_domain(spark, model, "   ")
    with pytest.raises(api.InvalidInput, match="neither a URL"):
        api.predict_domain(spark, model, "dfsdf")
    assert api.predict_domain(spark, model, " sbi-banking-verify.in ")["domain"] == "sbi-banking-verify.in"
    path = os.path.join(tmp_dir, "corr")
    api.report_mistake(spark, path, " Evil.TK ", "phishing", batch_id=1)
    with pytest.raises(api.InvalidInput):
        api.report_mistake(spark, path, "x.com", "spam", batch_id=2)
    assert [(r["domain"], r["label"]) for r in read_corrections(spark, path).collect()] == [("evil.tk", "phishing")]

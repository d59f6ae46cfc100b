"""Per-request helpers for callers that score or inspect one item at a time.

Each helper runs the library's DataFrame operators on a one-row (or bounded)
input and returns plain Python values; the batch / streaming paths are the
same operators on whole tables.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from hostscope.functions import lists
from hostscope.functions.host import valid_client, valid_server
from hostscope.operators.features import with_host_features, with_indicators
from hostscope.operators.model import score_domains
from hostscope.operators.requests import require_valid
from hostscope.operators.scanlog import scan_history, stats_document
from hostscope.sources.tables import append_corrections, append_scans


def _one(spark: SparkSession, value: str) -> DataFrame:
    return spark.createDataFrame([(value,)], "domain string")


def extract_features(spark: SparkSession, domain: str) -> dict:
    """The 23 features + ``tld`` of one domain or URL."""
    row = with_host_features(_one(spark, domain), "domain").first().asDict()
    row.pop("domain")
    return row


def additional_indicators(spark: SparkSession, domain: str) -> dict:
    row = with_indicators(_one(spark, domain), "domain").first().asDict()
    row.pop("domain")
    return row


def is_valid(spark: SparkSession, text: str, client: bool = False) -> bool:
    """V1 (server rule) or V2 (browser rule) for one input."""
    check = valid_client if client else valid_server
    return bool(_one(spark, text).select(check("domain")).first()[0])


class InvalidInput(ValueError):
    """A request the service rules reject."""


def predict_domain(spark: SparkSession, model: PipelineModel, domain: str, validate: bool = True,
                   log_path: str | None = None) -> dict:
    """M9 for one domain: domain, label, confidence, features, indicators.
    With ``validate`` the input is stripped and checked first (P11); with
    ``log_path`` the result is appended to the scan log."""
    if validate:
        domain = (domain or "").strip()
        if not domain:
            raise InvalidInput("empty input")
        if not is_valid(spark, domain):
            raise InvalidInput("neither a URL nor a domain")
    scored = score_domains(_one(spark, domain), model)
    if log_path:
        append_scans(scored, log_path)
    r = scored.first()
    return {
        "domain": r["domain"],
        "label": r["label"],
        "confidence": r["confidence"],
        "features": r["features"].asDict(),
        "additional_indicators": r["additional_indicators"].asDict(),
    }


def predict_batch(spark: SparkSession, model: PipelineModel, domains: list[str],
                  log_path: str | None = None, batch_id: int | None = None) -> DataFrame:
    """Batch request: drop invalid lines (error if none is valid), score the
    rest in order, optionally append them to the scan log."""
    rows = spark.createDataFrame([(i, d.strip()) for i, d in enumerate(domains)], "pos long, domain string")
    ok = require_valid(rows)
    scored = score_domains(ok, model).orderBy("pos")
    if log_path:
        append_scans(scored, log_path, batch_id)
    return scored


def report_mistake(spark: SparkSession, path: str, domain: str, corrected_label: str,
                   batch_id: int | None = None) -> None:
    """L1: validate (P12) and store one correction (trimmed, lower-cased)."""
    reports = spark.createDataFrame([(domain, corrected_label)], "domain string, corrected_label string")
    if append_corrections(reports, path, batch_id).count():
        raise InvalidInput("a correction needs a domain and one of the two labels")


def aggregate_stats(log: DataFrame) -> dict:
    """Total, per-label counts (both classes present) and the top
    risky TLDs, read from the one-row stats document (one action)."""
    r = stats_document(log, lists.TOP_TLDS).first()
    return {
        "total_scanned": r["total_scanned"],
        "label_counts": dict(r["label_counts"]),
        "top_risky_tlds": [{"tld": x["tld"], "count": x["count"]} for x in r["top_risky_tlds"]],
    }


def history(log: DataFrame, limit: int = lists.HISTORY_LIMIT) -> list[dict]:
    """O2 + L4: the latest ``limit`` scans (newest first) in the service's
    response shape, indicators recomputed; ``confidence_pct`` and
    ``triggered`` are the display derivations (V3, V4)."""
    out = []
    for r in scan_history(log, limit).collect():
        d = r.asDict(recursive=True)
        out.append({
            "domain": d["domain"],
            "label": d["label"],
            "confidence": d["confidence"],
            "timestamp": d["ts"],
            "features": d.get("features") or {},
            "additional_indicators": {k: d[k] for k in ("is_ip", "has_mixed_script", "tld_is_risky")},
            "confidence_pct": d["confidence_pct"],
            "triggered": d["triggered"],
        })
    return out

"""Job entry points (L2): run with ``spark-submit -m hostscope.jobs <job> ...``
or ``python -m hostscope.jobs <job> ...`` from any scheduler.

Jobs
  train  --data DIR [--corrections PATH] [--cache PATH] --model PATH [--trees N] [--weighted]
         [--write-combined PATH] [--variant app|notebook]
  score  --model PATH --input PATH --log PATH [--batch-id N]
  stats  --log PATH [--out PATH]
  stream --model PATH --input DIR --log PATH [--rejects PATH] [--trigger SEC]
  stream-stats --log PATH --out PATH [--trigger SEC]
  import-service --url JDBC_URL --log PATH --reports PATH [--user U --password P --driver CLASS]

All paths are Hadoop paths (shared storage on a cluster).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from hostscope.operators.model import TreeSettings, load_model, score_domains
from hostscope.operators.requests import require_valid
from hostscope.operators.scanlog import share_of, stats_of
from hostscope.operators.training import train_job
from hostscope.functions.urls import py_strip
from hostscope.session import get_spark, input_bytes, size_shuffles
from hostscope.sources.feeds import read_corrections, read_labelled, resolve_dataset, write_labelled
from hostscope.sources.log_index import log_sums
from hostscope.sources.tables import append_scans


def _train(spark, a) -> dict:
    size_shuffles(spark, input_bytes(spark, [a.data] + ([a.cache] if a.cache else [])))
    data = resolve_dataset(spark, a.data)
    if a.write_combined:  # S6: the deduplicated set, before augmentation
        write_labelled(data, a.write_combined)
        data = read_labelled(spark, a.write_combined)
    corr = read_corrections(spark, a.corrections) if a.corrections else None
    base = TreeSettings.notebook if a.variant == "notebook" else TreeSettings
    s = base(trees=a.trees) if a.trees else base()
    res = train_job(spark, data, corr, cache_path=a.cache, model_path=a.model, settings=s, weighted=a.weighted,
                    variant=a.variant)
    return {"metrics": res.metrics, "importances": res.importances[:10]}


def _score(spark, a) -> dict:
    size_shuffles(spark, input_bytes(spark, [a.input]))
    model = load_model(a.model)
    lines = spark.read.text(a.input).select(F.col("value").alias("domain"))
    ok = require_valid(lines).select(py_strip("domain").alias("domain"))  # the service strips
    scored = score_domains(ok, model)
    append_scans(scored, a.log, a.batch_id)
    return {"log": a.log}


def _stats(spark, a) -> dict:
    sums = log_sums(spark, a.log)  # from the index; the log itself is read for new batches only
    doc = stats_of(sums).first()
    out = {
        "share": share_of(sums).first().asDict(),
        "labels": dict(doc["label_counts"]),
        "top_risky_tlds": [x.asDict() for x in doc["top_risky_tlds"]],
    }
    if a.out:
        spark.createDataFrame([(json.dumps(out, default=str),)], "stats string").write.mode("overwrite").text(a.out)
    return out


def _stream(spark, a) -> dict:
    from hostscope.streaming.scoring import start_scoring

    q = start_scoring(spark, a.input, a.model, a.log, reject_path=a.rejects, trigger_seconds=a.trigger)
    q.awaitTermination()
    return {}


def _stream_stats(spark, a) -> dict:
    from hostscope.streaming.scoring import start_stats

    start_stats(spark, a.log, out_path=a.out, trigger_seconds=a.trigger)[0].awaitTermination()
    return {}


def _import_service(spark, a) -> dict:
    from hostscope.sources.tables import import_service_log

    props = {"user": a.user, "password": a.password} if a.user else {}
    if a.driver:
        props["driver"] = a.driver
    import_service_log(spark, a.url, a.log, a.reports, props, a.batch_id)
    return {"log": a.log, "reports": a.reports}


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="hostscope.jobs")
    p.add_argument("--master", help="only when not launched by spark-submit, e.g. local[8]")
    sub = p.add_subparsers(dest="job", required=True)
    t = sub.add_parser("train")
    t.add_argument("--data", required=True)
    t.add_argument("--corrections")
    t.add_argument("--cache")
    t.add_argument("--model", required=True)
    t.add_argument("--trees", type=int)
    t.add_argument("--weighted", action="store_true")
    t.add_argument("--write-combined", dest="write_combined")
    t.add_argument("--variant", choices=["app", "notebook"], default="app")
    s = sub.add_parser("score")
    s.add_argument("--model", required=True)
    s.add_argument("--input", required=True)
    s.add_argument("--log", required=True)
    s.add_argument("--batch-id", type=int, dest="batch_id")
    st = sub.add_parser("stats")
    st.add_argument("--log", required=True)
    st.add_argument("--out")
    sm = sub.add_parser("stream")
    sm.add_argument("--model", required=True)
    sm.add_argument("--input", required=True)
    sm.add_argument("--log", required=True)
    sm.add_argument("--rejects")
    sm.add_argument("--trigger", type=int)
    im = sub.add_parser("import-service")
    im.add_argument("--url", required=True, help="JDBC url of the service database")
    im.add_argument("--log", required=True)
    im.add_argument("--reports", required=True)
    im.add_argument("--user")
    im.add_argument("--password")
    im.add_argument("--driver")
    im.add_argument("--batch-id", type=int, dest="batch_id", help="replace this batch; without it a new one is appended")
    ss = sub.add_parser("stream-stats")
    ss.add_argument("--log", required=True)
    ss.add_argument("--out", required=True)
    ss.add_argument("--trigger", type=int)
    a = p.parse_args(argv)
    spark = get_spark(a.master)
    jobs = {"train": _train, "score": _score, "stats": _stats, "stream": _stream, "stream-stats": _stream_stats,
            "import-service": _import_service}
    out = jobs[a.job](spark, a)
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()

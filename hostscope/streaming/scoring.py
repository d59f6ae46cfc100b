"""Structured Streaming re-aim of the scoring service (R1) and its live
statistics (R2).

R1: files of submitted lines arrive in a folder -> one line per row
(trimmed, blank lines dropped) -> server-side validation (rejects go to
their own sink) -> features + model + trusted-root override -> appended to
the scan log.  Each micro-batch writes its own ``batch_id=<n>`` partition in
overwrite mode, so a replayed batch after a failure replaces its output
(exactly-once together with the checkpointed offsets).

R2: the log's files are a streaming source that says when something was written;
the statistics are the sums of the log's slices (``sources.log_index``), which are
replaced together with their batch.  A batch that is written again, after a failure or
by another import, therefore counts once, and a restart reads only batches whose slice
is missing or old.

The reference has no event time, so no watermark is needed.  Checkpoints lie
beside the log by default (``<log>.<name>``, ``<log>.stats``), so a restarted
stream finds its offsets.  Batch numbers are claimed one by one (``claim_number``),
so streams that share a log never take each other's.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostscope.functions.host import reject_reason
from hostscope.operators.model import score_domains
from hostscope.functions.urls import js_trim, py_strip
from hostscope.sources.log_index import index_batch, log_sums
from hostscope.sources.tables import SCAN_SCHEMA, claim_number, scan_rows, write_batch


def submitted_lines(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    """Streaming source: every line of every new file, trimmed, non-blank
    (S16 per line; files are read line by line, so large files split)."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    line = js_trim("value")
    return reader.load(source_dir).select(line.alias("domain")).where(F.length("domain") > 0)


def start_scoring(spark: SparkSession, source_dir: str, model: PipelineModel | str, log_path: str,
                  reject_path: str | None = None, checkpoint: str | None = None,
                  trigger_seconds: int | None = None, name: str = "scoring") -> StreamingQuery:
    """Continuous scoring into the scan log.  Several streams may write one log:
    give each its own ``name`` (or ``checkpoint``), under which it finds its offsets
    and the numbers of its batches after a restart."""
    if isinstance(model, str):
        model = PipelineModel.load(model)
    lines = submitted_lines(spark, source_dir)
    checkpoint = checkpoint or f"{log_path.rstrip('/')}.{name}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch_id = claim_number(spark, log_path, f"{checkpoint.rstrip('/')}.batches", batch_id)
        # both sinks read the tagged batch: keep it for the two writes
        tagged = batch.withColumn("reason", reject_reason("domain")).persist()
        try:
            if reject_path:
                write_batch(tagged.where(F.col("reason").isNotNull()), reject_path, batch_id)
            valid = tagged.where(F.col("reason").isNull()).select(py_strip("domain").alias("domain"))
            scored = score_domains(valid, model, "domain")
            write_batch(scan_rows(scored, batch_id), log_path, batch_id)
            index_batch(spark, log_path, batch_id)
        finally:
            tagged.unpersist()

    w = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def log_stream(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.readStream.schema(SCAN_SCHEMA).parquet(log_path)


def running_label_counts(sums: DataFrame) -> DataFrame:
    """R2 (G1/G2): rows per label over everything logged so far."""
    return sums.where(F.col("kind") == "label").select(F.col("key").alias("label"), "n")


def running_tld_counts(sums: DataFrame) -> DataFrame:
    """R2 (G3): phishing TLD histogram with first-seen id for tie-breaks."""
    return sums.where(F.col("kind") == "tld").select(F.col("key").alias("tld"), F.col("n").alias("count"), "first_id")


def start_stats(spark: SparkSession, log_path: str, sink: str = "memory", name: str = "scan_stats",
                checkpoint: str | None = None, out_path: str | None = None,
                trigger_seconds: int | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """R2: keep the statistics of a live log.

    With ``out_path`` each trigger overwrites ``<out_path>/labels`` and
    ``<out_path>/tlds`` (tables on shared storage, one row per label / TLD);
    otherwise they are the temporary views ``<name>_labels`` and ``<name>_tlds``.
    One query keeps both; it is returned for each."""
    if not out_path and sink != "memory":
        raise ValueError("give out_path for tables on storage")
    cp = checkpoint or f"{log_path.rstrip('/')}.stats"
    parts = {"labels": running_label_counts, "tlds": running_tld_counts}

    def handle(_batch: DataFrame, _batch_id: int) -> None:
        sums = log_sums(spark, log_path)
        for part, of in parts.items():
            if out_path:
                of(sums).write.mode("overwrite").parquet(f"{out_path}/{part}")
            else:
                of(sums).checkpoint(eager=True).createOrReplaceTempView(f"{name}_{part}")

    w = log_stream(spark, log_path).writeStream.foreachBatch(handle).queryName(f"{name}_labels")
    w = w.option("checkpointLocation", f"{cp}/index")
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    query = w.start()
    return query, query

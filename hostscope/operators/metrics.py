"""Evaluation metrics over a predictions relation.

Input columns: ``y`` (0/1 actual), ``pred`` (0/1 predicted), ``prob``
(probability of class 1) and optionally ``brand_match``.  Class 0 is
``legitimate`` and class 1 ``phishing`` (alphabetical encoding).

Every metric is one global aggregation (partial per task, one tiny final
merge); ROC-AUC adds a range-partitioned pass over distinct scores, so no
step gathers rows into a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.session import ensure_checkpoint_dir


_MAX_BROADCAST_RANGES = 100_000


def _counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    def c(a, p):
        return F.sum(F.when((F.col(y) == a) & (F.col(pred) == p), 1).otherwise(0)).cast("long")

    return df.agg(
        c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(1, 1).alias("tp")
    )


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(actual, predicted, n) for the 2x2 matrix, zero-filled."""
    return _counts(df, y, pred).select(
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, n)")
    )


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def class_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class precision / recall / F1 / support, plus the accuracy,
    macro-average and weighted-average rows of a classification report.

    One aggregation (one scan) yields the four counts; the five report rows
    are built from that single row and exploded."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    f0 = _safe_div(2 * p0 * r0, p0 + r0)
    f1 = _safe_div(2 * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, fn + tp

    def row(label, prec, rec, f, sup):
        return F.struct(F.lit(label).alias("label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row(lists.LABELS[0], p0, r0, f0, s0),
        row(lists.LABELS[1], p1, r1, f1, s1),
        row("accuracy", none, none, _safe_div(tn + tp, n), n),
        row("macro avg", (p0 + p1) / 2.0, (r0 + r1) / 2.0, (f0 + f1) / 2.0, n),
        row("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n),
            _safe_div(f0 * s0 + f1 * s1, n), n),
    )
    return _counts(df, y, pred).select(F.inline(rows))


def weighted_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (one row)."""
    cm = _counts(df, y, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    f0 = _safe_div(2 * p0 * r0, p0 + r0)
    f1 = _safe_div(2 * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, fn + tp
    return cm.select(
        n.alias("n"),
        _safe_div(tn + tp, n).alias("accuracy"),
        _safe_div(p0 * s0 + p1 * s1, n).alias("precision_weighted"),
        _safe_div(r0 * s0 + r1 * s1, n).alias("recall_weighted"),
        _safe_div(f0 * s0 + f1 * s1, n).alias("f1_weighted"),
    )


def roc_auc(df: DataFrame, y: str = "y", prob: str = "prob", partitions: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count one half), as one row ``(n_pos, n_neg, auc)``.

    AUC = sum over scores s of pos(s) * (neg(< s) + neg(= s) / 2) / (P * N).
    Distinct scores are aggregated (partial + final), range-partitioned by
    score, and the running negative count is each range's local running sum
    plus the total of all lower ranges (a bounded per-partition table).
    """
    spark = df.sparkSession
    by_score = df.groupBy(F.col(prob).alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("long").alias("neg"),
    )
    nparts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range id is materialised once (reliable checkpoint in the shared
    # folder) so both uses below see the same score -> range assignment.
    ensure_checkpoint_dir(spark)
    ranged = (
        by_score.repartitionByRange(nparts, "s")
        .withColumn("pid", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    part_tot = ranged.groupBy("pid").agg(F.sum("neg").alias("neg_p"), F.min("s").alias("lo"))
    # offsets: negatives in all lower-valued ranges (tiny: one row per range)
    w_off = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_tot.select("pid", F.coalesce(F.sum("neg_p").over(w_off), F.lit(0)).alias("off"))
    w_loc = Window.partitionBy("pid").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("below", F.coalesce(F.sum("neg").over(w_loc), F.lit(0)))
    # one offset row per range partition: broadcast only while that count is small
    joined = local.join(F.broadcast(offsets) if nparts <= _MAX_BROADCAST_RANGES else offsets, "pid")
    contrib = F.col("pos").cast("double") * ((F.col("below") + F.col("off")).cast("double") + F.col("neg") / 2.0)
    tot = joined.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(contrib).alias("num")
    )
    return tot.select(
        F.col("n_pos").cast("long"), F.col("n_neg").cast("long"),
        F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double"))
        .otherwise(F.col("num") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
        .alias("auc"),
    )


def sliced_accuracy(df: DataFrame, slice_col: str = "brand_match", y: str = "y",
                    pred: str = "pred", floor: float = 0.95) -> DataFrame:
    """Accuracy on rows where ``slice_col`` = 1, whether it beats
    ``floor``, or a 'no samples' note when the slice is empty."""
    s = df.where(F.col(slice_col) == 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(y) == F.col(pred), 1).otherwise(0)).alias("correct"),
    )
    acc = F.when(F.col("n") == 0, F.lit(None).cast("double")).otherwise(
        F.col("correct").cast("double") / F.col("n").cast("double")
    )
    return s.select(
        F.col("n").cast("long").alias("n"),
        acc.alias("accuracy"),
        F.when(F.col("n") == 0, F.lit(None).cast("boolean")).otherwise(acc > floor).alias("above_floor"),
        F.when(F.col("n") == 0, F.lit("no samples")).otherwise(F.lit("ok")).alias("note"),
    )

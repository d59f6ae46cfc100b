"""The training job (M11, L2, L3): dataset -> balance -> incremental feature
cache -> join -> split -> fit -> evaluate -> save.

Run it from any scheduler (``python -m hostscope.jobs train ...``); every
step is a DataFrame plan, and the only values that reach the driver are
bounded summaries (class counts, hash-prefix histograms, metric rows and
the 23 feature importances).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.operators import dataset as D
from hostscope.operators import metrics as M
from hostscope.operators.features import with_host_features, with_notebook_features_2
from hostscope.operators.joins import hot_keys, key_counts, split_join
from hostscope.operators.model import TreeSettings, feature_importance, fit, predict, save_model
from hostscope.session import ensure_checkpoint_dir, remove_path
from hostscope.sources.feature_cache import create_cache, open_cache, upsert
from hostscope.sources.feeds import append_feature_cache, curated_rows, path_exists, read_feature_cache


def build_dataset(spark: SparkSession, labelled: DataFrame, corrections: DataFrame | None = None,
                  copies: int = lists.CURATED_COPIES, weighted: bool = False) -> DataFrame:
    """A2 + A3 + S10: base rows, curated rows and latest corrections, the
    latter two ``copies`` times (or once with ``weight = copies``).

    Adds ``src`` and ``copy`` so ``(domain, label, src, copy)`` is a unique
    row key for the hash order used by balancing and splitting.
    """
    base = labelled.select("domain", "label", F.lit("base").alias("src"), F.lit(0).alias("copy"),
                           F.lit(1.0).alias("weight"))
    extra = [curated_rows(spark).withColumn("src", F.lit("curated"))]
    if corrections is not None:
        latest = D.keep_last(corrections.select("domain", "label", "ts", "id"), "domain", ("ts", "id"))
        extra.append(latest.select("domain", "label", F.lit("report").alias("src")))
    parts = [base]
    for e in extra:
        if weighted:
            parts.append(e.select("domain", "label", "src", F.lit(0).alias("copy"),
                                  F.lit(float(copies)).alias("weight")))
        else:
            parts.append(D.replicate(e, copies).select("domain", "label", "src", F.col("copy").cast("int"),
                                                       F.lit(1.0).alias("weight")))
    return D.union_all(parts)


def row_key(df: DataFrame):
    return F.concat_ws(":", "domain", "label", "src", F.col("copy").cast("string"))


def features_with_cache(spark: SparkSession, domains: DataFrame, cache_path: str | None,
                        distinct: bool = False) -> DataFrame:
    """S8 + J2 + H22 + S9 (L3): features for every domain, extracting only
    the ones the cache lacks and adding those to it (a keyed cache; a plain folder
    is used and appended to as it is).  ``distinct`` says the domains are already
    unique (no extra shuffle)."""
    uniq = domains.select("domain")
    if not distinct:
        uniq = uniq.distinct()  # D3: once per domain
    if not cache_path:
        return with_host_features(uniq, "domain")
    if open_cache(spark, cache_path) is not None:
        upsert(spark, uniq, cache_path, lambda d: with_host_features(d, "domain"))
        return open_cache(spark, cache_path)
    cached = read_feature_cache(spark, cache_path)  # a plain folder, as older runs left it
    if cached is None:
        if path_exists(spark, cache_path):  # it lacks model columns
            remove_path(spark, cache_path)
            remove_path(spark, f"{cache_path.rstrip('/')}.buckets")
        create_cache(with_host_features(uniq, "domain"), cache_path)
        return open_cache(spark, cache_path)
    missing = uniq.join(cached.select("domain"), "domain", "left_anti")  # J2
    new = with_host_features(missing, "domain")
    append_feature_cache(new, cache_path)
    return read_feature_cache(spark, cache_path)


@dataclass
class TrainResult:
    model: PipelineModel
    metrics: dict
    importances: list


def train_job(spark: SparkSession, labelled: DataFrame, corrections: DataFrame | None = None,
              cache_path: str | None = None, model_path: str | None = None,
              settings: TreeSettings | None = None, weighted: bool = False,
              keep_copies_together: bool = False, variant: str = "app") -> TrainResult:
    """The full job.  ``labelled`` has ``domain, label``.

    ``variant="notebook"`` is the notebook's flow (M4): no curated rows or
    corrections, balancing shrinks only the legitimate class, the notebook
    feature set (substring brand match, its TLD lists) and, by default,
    the notebook's tree settings with A7 sample weights.
    """
    if variant == "notebook":
        return _train_notebook(spark, labelled, model_path, settings or TreeSettings.notebook())
    s = settings or TreeSettings()
    if weighted and s.weight_col is None:
        s = replace(s, weight_col="weight")  # curated rows and corrections count as their copies
    ensure_checkpoint_dir(spark)
    data = build_dataset(spark, labelled, corrections, weighted=weighted)
    # A4; written once: the counts and both branches of the join read it
    balanced = D.balance_downsample(data, row_key(data)).checkpoint(eager=True)
    # rows per domain: the distinct domains for extraction (D3) and the hot
    # keys for a skew-safe J1, from one checkpointed aggregation
    counts = key_counts(balanced, ["domain"]).checkpoint(eager=True)
    feats = features_with_cache(spark, counts.select("domain"), cache_path, distinct=True)
    hot = hot_keys(counts, ["domain"])
    # J1, then cut the lineage: the split, the fit and both evaluations all
    # read these rows (reliable checkpoint in the shared folder).
    rows = split_join(balanced, feats.drop("label"), ["domain"], hot).checkpoint(eager=True)
    if keep_copies_together:
        rows = D.stratified_group_split(rows, "domain")
    else:
        rows = D.stratified_split(rows, row_key(rows))  # A6
    if s.weight_col == "weight" and not weighted:
        rows = D.sample_weights(rows)
    elif s.weight_col == "weight" and settings is not None and settings.weight_col == "weight":
        # both asked for: copies times the row weights
        rows = D.sample_weights(rows, "__a7").withColumn("weight", F.col("weight") * F.col("__a7")).drop("__a7")
    train = rows.where(F.col("split") == "train")
    model = fit(train, s)
    return _finish(model, rows, model_path)


def _evaluate(model: PipelineModel, rows: DataFrame) -> dict:
    out: dict = {}
    for name in ("valid", "test"):
        part = predict(model, rows.where(F.col("split") == name))
        preds = part.select(
            F.when(F.col("label") == lists.PHISHING, 1).otherwise(0).alias("y"),
            F.col("pred_idx").alias("pred"), "prob", "brand_match",
        )
        out[name] = {
            "confusion": [r.asDict() for r in M.confusion_matrix(preds).collect()],
            "scores": M.weighted_metrics(preds).first().asDict(),
            "report": [r.asDict() for r in M.class_metrics(preds).collect()],
            "auc": M.roc_auc(preds).first()["auc"],
            "brand_slice": M.sliced_accuracy(preds).first().asDict(),
        }
    return out


def _finish(model: PipelineModel, rows: DataFrame, model_path: str | None) -> TrainResult:
    metrics = _evaluate(model, rows)
    imps = [(r["feature"], r["importance"]) for r in feature_importance(model).collect()]
    if model_path:
        save_model(model, model_path)
    return TrainResult(model, metrics, imps)


def _train_notebook(spark: SparkSession, labelled: DataFrame, model_path: str | None,
                    s: TreeSettings) -> TrainResult:
    ensure_checkpoint_dir(spark)
    data = labelled.select("domain", "label")
    key = F.concat_ws(":", "domain", "label")
    # A4 (notebook); written once: the counts and both join branches read it
    balanced = D.balance_downsample(data, key, only_shrink=lists.LEGITIMATE).checkpoint(eager=True)
    counts = key_counts(balanced, ["domain"]).checkpoint(eager=True)
    feats = with_notebook_features_2(counts.select("domain"), "domain")
    rows = split_join(balanced, feats, ["domain"], hot_keys(counts, ["domain"])).checkpoint(eager=True)
    rows = D.stratified_split(rows, F.concat_ws(":", "domain", "label"))  # A6
    if s.weight_col == "weight":
        rows = D.sample_weights(rows)  # A7
    model = fit(rows.where(F.col("split") == "train"), s)
    return _finish(model, rows, model_path)

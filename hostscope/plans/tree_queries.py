"""Queries over boosted trees whose splits are given: scores of every URL host (M5-M8),
the gain of every split of the root over the labelled hosts (M3), and importance by
the average gain that given trees have there (G13, O4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.operators import boosting as B
from hostscope.operators import features as FT
from hostscope.plans import derived as DV
from hostscope.plans import sqlfn as Q
from hostscope.plans.catalog import HP, R9, _feature_sql, _with, register

# FIXED VALUES: four small trees of our own, by place; (feature, threshold) or a value.
_GIVEN = [
    {0: ("min_brand_distance", 1), 1: ("hyphen_count", 0), 2: ("length", 18), 3: -0.12, 4: 0.31, 5: 0.22, 6: -0.27},
    {0: ("is_suspicious_tld", 0), 1: ("subdomain_count", 0), 2: 0.33, 3: -0.15, 4: 0.08},
    {0: ("has_login", 0), 1: ("digit_count", 2), 2: 0.25, 3: ("is_common_tld", 0), 4: 0.11, 7: 0.07, 8: -0.19},
    {0: ("contains_unicode", 0), 1: ("special_char_count", 1), 2: 0.4, 3: -0.05, 4: 0.16},
]
GIVEN = B.BoostedTrees(list(lists.FEATURE_ORDER), [
    B.Node(t, place, *((x[0], float(x[1]), 0.0) if isinstance(x, tuple) else (None, None, x)), 0.0, 0.0)
    for t, tree in enumerate(_GIVEN) for place, x in tree.items()
])

_PROB = f"1.0 / (1.0 + exp(-({GIVEN.margin_sql()})))"
_LAB = _with(["labelled"], [
    Q.rules_cte(), ("lab_h", f"SELECT id, label, {Q.clean_host('domain')} AS host FROM labelled"),
    *Q.split_ctes("lab_h", "host", "lp"), ("feats", f"SELECT id, label, {_feature_sql()} FROM lp"),
])


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return FT.with_host_features(DV.spark_labelled(spark, sf), "domain")


@register(
    "score_trees",
    HP + f", feats AS (SELECT src, uid, {_feature_sql()} FROM hp), scored AS (SELECT *, {_PROB} AS p FROM feats) "
    f"SELECT src, uid, CASE WHEN known_brand_root = 1 OR p < 0.5 THEN '{lists.LEGITIMATE}' ELSE '{lists.PHISHING}' END AS label, "
    f"CASE WHEN known_brand_root = 1 THEN 1.0 ELSE round(greatest(p, 1 - p), {R9}) END AS confidence FROM scored",
)
def score_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every URL host scored by the given trees, with the trusted-root override."""
    scored = GIVEN.predict(FT.with_host_features(DV.spark_urls(spark, sf), "url"))
    trusted = F.col("known_brand_root") == 1
    return scored.select(
        "src", "uid", F.when(trusted, F.lit(lists.LEGITIMATE)).otherwise(F.col("pred_label")).alias("label"),
        F.when(trusted, F.lit(1.0)).otherwise(F.round("confidence", R9)).alias("confidence"))


#: Continuous features are taken in sixteenths.
_STEPPED = ("entropy", "unicode_ratio")
_VALUES = {f: f"floor(round({f}, 9) * 16) / 16" if f in _STEPPED else f for f in lists.FEATURE_ORDER}


@register(
    "split_gains",
    _LAB + ", long AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, ({x})::DOUBLE AS threshold, CASE WHEN label = '{lists.PHISHING}' THEN -0.5 ELSE 0.5 END::DOUBLE AS g "
        "FROM feats" for f, x in _VALUES.items())
    + "), sums AS (SELECT feature, threshold, count(*) AS n, sum(g) AS g, count(*) * 0.25::DOUBLE AS h FROM long GROUP BY 1, 2), "
    "run AS (SELECT feature, threshold, (sum(n) OVER a)::BIGINT AS n_left, (sum(n) OVER b)::BIGINT AS n, sum(g) OVER a AS gl, "
    "sum(h) OVER a AS hl, sum(g) OVER b AS gt, sum(h) OVER b AS ht FROM sums WINDOW a AS (PARTITION BY feature ORDER BY threshold "
    "ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY feature)) "
    "SELECT feature, threshold, n_left, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 9) "
    "AS gain FROM run WHERE n_left < n",
)
def split_gains(spark: SparkSession, sf: str) -> DataFrame:
    """The second-order gain of every split of a first tree's root over all labelled hosts."""
    feats = _labelled(spark, sf)
    for f in _STEPPED:
        feats = feats.withColumn(f, F.expr(_VALUES[f]))
    g = F.when(F.col("label") == lists.PHISHING, -0.5).otherwise(0.5)
    out = B.split_gains(feats, list(lists.FEATURE_ORDER), g, F.lit(0.25))
    return out.withColumn("gain", F.round("gain", R9))


def _measured_sql() -> str:
    """Gains by the condition under which a row reaches each split."""
    parts, before = [], "0.0::DOUBLE"
    for t, tree in enumerate(GIVEN.trees()):
        at = {n.node: n for n in tree}
        p = f"(1.0 / (1.0 + exp(-({before}))))"
        for n in tree:
            if n.feature is None:
                continue
            conds, place = [], n.node
            while place:
                up = at[(place - 1) // 2]
                conds.append(f"{up.feature} {'>' if place % 2 == 0 else '<='} {up.threshold!r}")
                place = up.node
            right = f"{n.feature} > {n.threshold!r}"
            parts.append(
                f"SELECT {t} AS tree, {n.node} AS node, '{n.feature}' AS feature, count(*) AS n, "
                f"coalesce(sum(g) FILTER (WHERE {right}), 0) AS gr, coalesce(sum(h) FILTER (WHERE {right}), 0) AS hr, "
                f"sum(g) AS gt, sum(h) AS ht FROM (SELECT *, {p} - CASE WHEN label = '{lists.PHISHING}' THEN 1 ELSE 0 END AS g, "
                f"{p} * (1 - {p}) AS h FROM feats) WHERE {' AND '.join(conds) or 'true'} HAVING count(*) > 0")
        before += f" + ({GIVEN.tree_sql(tree)})"
    return (
        ", nodes AS (" + " UNION ALL ".join(parts) + "), gains AS (SELECT tree, node, feature, n, "
        "(gt - gr) * (gt - gr) / (ht - hr + 1) + gr * gr / (hr + 1) - gt * gt / (ht + 1) AS gain FROM nodes)")


@register("tree_split_gains", _LAB + _measured_sql() + " SELECT tree, node, feature, n, round(gain, 6) AS gain FROM gains")
def tree_split_gains(spark: SparkSession, sf: str) -> DataFrame:
    """The gain of each split of the given trees over all labelled hosts."""
    out = B.measured_splits(_labelled(spark, sf), GIVEN, F.col("label") == lists.PHISHING)
    return out.withColumn("gain", F.round("gain", 6))


_FEATURE_VALUES = ", ".join(f"('{f}')" for f in lists.FEATURE_ORDER)


@register(
    "importance_by_gain",
    _LAB + _measured_sql() + ", a AS (SELECT feature, avg(gain) AS average FROM gains GROUP BY 1) "
    "SELECT f.feature, round(coalesce(average, 0) / (SELECT sum(average) FROM a), 9) AS importance "
    f"FROM (VALUES {_FEATURE_VALUES}) f(feature) LEFT JOIN a ON a.feature = f.feature",
)
def importance_by_gain(spark: SparkSession, sf: str) -> DataFrame:
    """G13 + O4: average gain of the given trees' splits over all labelled hosts."""
    splits = B.measured_splits(_labelled(spark, sf), GIVEN, F.col("label") == lists.PHISHING)
    out = B.average_gain(splits, GIVEN.features).withColumn("importance", F.round("importance", R9))
    return out.orderBy(F.desc("importance"), "feature")

"""Queries over the scan log.

The log has ``id, domain, label, confidence, ts`` (+ ``features``).  Every
statistic is an aggregation with partial aggregation per task; the top-k
reports are ``orderBy(...).limit(k)``, which Spark runs as a per-task top-k
(TakeOrderedAndProject) -- nothing but k rows per task ever moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.functions.urls import clean_host
from hostscope.operators.dataset import label_histogram
from hostscope.operators.features import with_indicators
from hostscope.session import ensure_checkpoint_dir


def half_up_pct(x: Column) -> Column:
    """``Math.round(x * 100)`` (round half up) as an integer."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("long")


def scan_stats(log: DataFrame) -> DataFrame:
    """G1 + G2: total rows and the two class counts (one row)."""
    return log.agg(
        F.count(F.lit(1)).alias("total_scanned"),
        F.sum(F.when(F.col("label") == lists.LEGITIMATE, 1).otherwise(0)).cast("long").alias("legitimate"),
        F.sum(F.when(F.col("label") == lists.PHISHING, 1).otherwise(0)).cast("long").alias("phishing"),
    ).select(
        F.col("total_scanned").cast("long"),
        F.coalesce("legitimate", F.lit(0)).alias("legitimate"),
        F.coalesce("phishing", F.lit(0)).alias("phishing"),
    )


def label_counts(log: DataFrame) -> DataFrame:
    """(label, n) for every label seen, both classes always present."""
    return label_histogram(log, "label")


def class_share(log: DataFrame) -> DataFrame:
    """Whole-percent class shares (half up); 50 / 50 on an empty log."""
    return _with_shares(scan_stats(log))


def share_of(partials: DataFrame) -> DataFrame:
    """G5 from partials (``log_partials``)."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col("key") == c, F.col("n"))), F.lit(0)).cast("long").alias(c)
    labels = partials.where(F.col("kind") == "label")
    return _with_shares(labels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_scanned"), of(lists.LEGITIMATE), of(lists.PHISHING)))


def _with_shares(s: DataFrame) -> DataFrame:
    tot = F.col("legitimate") + F.col("phishing")
    share = lambda c: F.when(tot == 0, F.lit(50).cast("long")).otherwise(
        half_up_pct(F.col(c).cast("double") / tot.cast("double"))
    )
    return s.select(
        "total_scanned", "legitimate", "phishing",
        share("legitimate").alias("legitimate_pct"),
        share("phishing").alias("phishing_pct"),
    )


def raw_tld(domain: Column) -> Column:
    """Last dot label of the stored domain, lower-cased; null without a dot."""
    return F.when(domain.contains("."), F.lower(F.substring_index(domain, ".", -1)))


def top_risky_tlds(log: DataFrame, k: int = lists.TOP_TLDS, clean_first: bool = False) -> DataFrame:
    """G3 + O3 + G6: the k most frequent TLDs among phishing rows, ties by
    first appearance (smallest id); ``bar_pct`` scales by the top count."""
    d = clean_host(F.col("domain")) if clean_first else F.col("domain")
    tlds = (
        log.where(F.col("label") == lists.PHISHING)
        .select(raw_tld(d).alias("tld"), "id")
        .where(F.col("tld").isNotNull())
        .groupBy("tld")
        .agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("first_id"))
    )
    top = tlds.orderBy(F.desc("count"), F.asc("first_id")).limit(k)
    # k rows at most: the window below runs on that tiny result
    w = Window.orderBy(F.desc("count"), F.asc("first_id"))
    return top.select(
        F.row_number().over(w).cast("long").alias("rank"),
        "tld",
        F.col("count").cast("long").alias("count"),
        half_up_pct(F.col("count") / F.max("count").over(Window.partitionBy())).alias("bar_pct"),
    )


INDICATOR_NAMES = ["is_ip", "has_mixed_script", "tld_is_risky"]


def triggered_indicators(prefix: str = "") -> Column:
    """V4: comma-joined names of the true indicators, or 'none'."""
    flags = F.array_compact(
        F.array(*[F.when(F.col(prefix + n), F.lit(n)) for n in INDICATOR_NAMES])
    )
    return F.when(F.size(flags) == 0, F.lit("none")).otherwise(F.array_join(flags, ","))


def scan_history(log: DataFrame, limit: int = lists.HISTORY_LIMIT, rules: DataFrame | None = None) -> DataFrame:
    """O2 + L4 + V3 + V4: latest ``limit`` rows (ts desc, id desc) with the
    indicators recomputed from the stored domain."""
    cols = [c for c in ("id", "domain", "label", "confidence", "ts", "features") if c in log.columns]
    return history_of(log.select(*cols), limit, rules)


def history_of(rows: DataFrame, limit: int, rules: DataFrame | None = None) -> DataFrame:
    """The same over rows that are known to hold the latest ones."""
    cols = rows.columns
    # The top-k runs as its own job so it plans as a per-task top-k
    # (TakeOrderedAndProject) instead of a full sort of the log; the k rows
    # are kept with a reliable checkpoint and the indicator joins see only them.
    ensure_checkpoint_dir(rows.sparkSession)
    latest = rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit).checkpoint(eager=True)
    out = with_indicators(latest, "domain", rules)
    return out.select(
        *cols,
        *INDICATOR_NAMES,
        half_up_pct(F.col("confidence")).alias("confidence_pct"),
        triggered_indicators().alias("triggered"),
    )


def log_partials(log: DataFrame, *by: str) -> DataFrame:
    """``kind, key, n, first_id`` (+ ``by``): rows per label and phishing rows per raw
    TLD with the least id, in one pass.  Such rows of parts of a log add up to those
    of the whole (``merged``)."""
    tld = F.when(F.col("label") == lists.PHISHING, raw_tld(F.col("domain")))
    facts = F.array(
        F.struct(F.lit("label").alias("kind"), F.col("label").alias("key"), F.lit(None).cast("long").alias("id")),
        F.struct(F.lit("tld").alias("kind"), tld.alias("key"), F.col("id").cast("long").alias("id")))
    rows = log.select(*by, F.explode(facts).alias("f")).select(*by, "f.*")
    return (
        rows.where((F.col("kind") == "label") | F.col("key").isNotNull())
        .groupBy(*by, "kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")))


def merged(parts: DataFrame) -> DataFrame:
    """Partials of several parts of a log, added up."""
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


def stats_of(partials: DataFrame, k: int = lists.TOP_TLDS) -> DataFrame:
    """G4 from partials, one row: ``total_scanned``, ``label_counts`` (map label -> n,
    both classes present; rows without a label count in the total alone) and
    ``top_risky_tlds`` (array of {tld, count} in rank order).  The partials, a row a
    label and TLD, are written once; the parts read from them are bounded (one row,
    #labels, k rows) and folded by one tiny aggregation."""
    ensure_checkpoint_dir(partials.sparkSession)
    partials = partials.checkpoint(eager=True)
    counts_t = "map<string,bigint>"
    top_t = "array<struct<tld:string,count:bigint>>"
    zeros = partials.sparkSession.createDataFrame([("label", c, 0, None) for c in lists.LABELS], "kind string, key string, n long, first_id long")
    labels = partials.where(F.col("kind") == "label").unionByName(zeros).groupBy("key").agg(F.sum("n").alias("n"))
    seen = F.col("key").isNotNull()
    counted = labels.agg(
        F.sum("n").alias("total_scanned"),
        F.map_from_entries(F.collect_list(F.when(seen, F.struct("key", "n")))).alias("label_counts"),
    ).withColumn("top_risky_tlds", F.lit(None).cast(top_t))
    ranked = partials.where(F.col("kind") == "tld").orderBy(F.desc("n"), F.asc("first_id")).limit(k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first_id", "key", "n")))
    top = ranked.agg(F.transform(order, lambda x: F.struct(x["key"].alias("tld"), x["n"].alias("count"))).alias("t")).select(
        F.lit(None).cast("bigint").alias("total_scanned"), F.lit(None).cast(counts_t).alias("label_counts"),
        F.coalesce(F.col("t"), F.array().cast(top_t)).alias("top_risky_tlds"))
    both = counted.unionByName(top)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c)
                      for c in ("total_scanned", "label_counts", "top_risky_tlds")])


def stats_document(log: DataFrame, k: int = lists.TOP_TLDS) -> DataFrame:
    """G4 as one row (see ``stats_of``), from one scan of the log."""
    return stats_of(log_partials(log), k)


def stats_rows(document: DataFrame) -> DataFrame:
    """The document as rows ``section, rank, key, n``: the total, the labels in
    alphabetical order and the TLDs in rank order."""
    labels = F.array_sort(F.map_entries("label_counts"))
    line = "struct<section:string,rank:bigint,key:string,n:bigint>"
    of = lambda section, rank, key, n: F.struct(
        F.lit(section).alias("section"), rank.cast("long").alias("rank"), key.alias("key"), n.alias("n")).cast(line)
    rows = F.concat(
        F.array(of("total", F.lit(1), F.lit("rows"), F.col("total_scanned"))),
        F.transform(labels, lambda e, i: of("label", i + 1, e["key"], e["value"])),
        F.transform("top_risky_tlds", lambda e, i: of("tld", i + 1, e["tld"], e["count"])))
    return document.select(F.inline(rows))

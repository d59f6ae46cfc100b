"""Registered-domain split (U4): host -> subdomain / root / suffix.

Plan shape: the host's last 1..K labels are looked up in the suffix-rule
table with K left joins against a broadcast copy of that table (K is the
longest rule, 4 for the real list).  The rule table has a checked size bound
(``MAX_RULES``), so every join is a BroadcastHashJoin: the host side is never
shuffled and the whole split is one narrow stage.

The chosen suffix is the longest of
  * an exact rule ``s_k``,
  * a wildcard: the host has a k-th label, ``s_{k-1}`` has a ``*.`` rule and
    ``s_k`` is not an exception,
  * an exception ``!s_k``, which yields ``s_{k-1}``.
No match -> empty suffix, the last label is the root.  A dotted-quad IPv4 with
no suffix is its own root.  A host equal to a suffix has an empty root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostscope.functions.host import is_ipv4
from hostscope.functions.urls import ColumnOrName, _col, py_strip
from hostscope.sources.suffix_list import MAX_RULES, max_rule_labels, suffix_rule_rows, suffix_rules


_RULES: dict = {}


def default_rules(spark) -> DataFrame:
    """The bundled rule table, built once per session."""
    key = spark.sparkContext.applicationId
    if key not in _RULES:
        # kept in memory (a few hundred KB) so every query's broadcast is
        # built from cached rows; a lost block is rebuilt from the driver's list
        _RULES[key] = suffix_rules(spark).persist()
    return _RULES[key]


def lenient_host(host: ColumnOrName) -> Column:
    """Host part the suffix lookup sees: no path/query/fragment, userinfo,
    port, surrounding spaces or trailing root dots; ideographic full stops
    become '.'."""
    h = _col(host)
    for sep in ("/", "?", "#"):
        h = F.substring_index(h, sep, 1)
    h = F.substring_index(h, "@", -1)
    h = F.substring_index(h, ":", 1)
    h = py_strip(h)
    h = F.regexp_replace(h, "[.。．｡]+$", "")
    return F.translate(h, "。．｡", "...")


def _rule_depth(rules: DataFrame) -> int | None:
    """Labels of the longest suffix the rule table can produce."""
    labels = F.size(F.split("key", r"\.")) + F.col("is_wild_parent").cast("int")
    return rules.agg(F.max(labels)).first()[0]


def split_registered(
    df: DataFrame,
    host: ColumnOrName,
    rules: DataFrame | None = None,
    subdomain: str = "subdomain",
    root: str = "root",
    suffix: str = "suffix",
    max_labels: int | None = None,
) -> DataFrame:
    """Add ``subdomain``, ``root`` and ``suffix`` columns for ``host``."""
    spark = df.sparkSession
    if rules is None:
        rules = default_rules(spark)
        max_labels = max_labels or max_rule_labels(suffix_rule_rows())
        can_broadcast = True  # built from a size-checked list
    else:
        # A caller-supplied table is broadcast only when its size is proven
        # small; otherwise the joins fall back to shuffle joins.
        can_broadcast = rules.limit(MAX_RULES + 1).count() <= MAX_RULES
        max_labels = max_labels or _rule_depth(rules)
    k_max = max_labels or 1

    tmp = "__sfx"
    h = lenient_host(host)
    out = df.withColumn(f"{tmp}_h", h).withColumn(
        f"{tmp}_l", F.split(F.col(f"{tmp}_h"), r"\.", -1)
    )
    labels = F.col(f"{tmp}_l")
    n = F.size(labels)
    lowered = F.split(F.lower(F.col(f"{tmp}_h")), r"\.", -1)
    for k in range(1, k_max + 1):
        out = out.withColumn(
            f"{tmp}_s{k}", F.when(n >= k, F.array_join(F.slice(lowered, -k, k), "."))
        )
    # The same broadcast relation is joined K times under aliases, so the
    # planner ships the table once and reuses that exchange for every join.
    small = F.broadcast(rules) if can_broadcast else rules
    for k in range(1, k_max + 1):
        a = f"{tmp}r{k}"
        out = out.join(small.alias(a), F.col(f"{tmp}_s{k}") == F.col(f"{a}.key"), "left").select(
            *[F.col(c) for c in out.columns],
            F.col(f"{a}.is_exact").alias(f"{tmp}_e{k}"),
            F.col(f"{a}.is_wild_parent").alias(f"{tmp}_w{k}"),
            F.col(f"{a}.is_exception").alias(f"{tmp}_x{k}"),
        )

    cands = [F.lit(0)]
    for k in range(1, k_max + 1):
        e = F.coalesce(F.col(f"{tmp}_e{k}"), F.lit(False))
        x = F.coalesce(F.col(f"{tmp}_x{k}"), F.lit(False))
        cands.append(F.when(e, F.lit(k)))
        cands.append(F.when(x, F.lit(k - 1)))
        if k >= 2:
            # a wildcard needs a k-th label to stand for the '*'
            w = F.coalesce(F.col(f"{tmp}_w{k - 1}"), F.lit(False))
            cands.append(F.when(w & ~x & (n >= k), F.lit(k)))
    L = F.greatest(*cands)

    out = out.withColumn(f"{tmp}_slen", L)
    L = F.col(f"{tmp}_slen")
    hcol = F.col(f"{tmp}_h")
    ip = (L == 0) & (n == 4) & hcol.rlike("^[0-9]") & is_ipv4(hcol)
    sub_len = n - L - 1
    out = out.select(
        "*",
        F.when(hcol.isNull(), F.lit(None).cast("string"))
        .when(ip, F.lit(""))
        .when(sub_len > 0, F.array_join(F.slice(labels, 1, F.greatest(sub_len, F.lit(1))), "."))
        .otherwise(F.lit(""))
        .alias(subdomain),
        F.when(hcol.isNull(), F.lit(None).cast("string"))
        .when(ip, hcol)
        .when(n > L, F.element_at(labels, F.greatest(n - L, F.lit(1))))
        .otherwise(F.lit(""))
        .alias(root),
        F.when(hcol.isNull(), F.lit(None).cast("string"))
        .when(ip, F.lit(""))
        .when(L > 0, F.array_join(F.slice(labels, -F.greatest(L, F.lit(1)), F.greatest(L, F.lit(1))), "."))
        .otherwise(F.lit(""))
        .alias(suffix),
    )
    return out.drop(*[c for c in out.columns if c.startswith(tmp)])

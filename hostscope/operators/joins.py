"""Skew-safe equi-join for a many-rows side against a one-row-per-key side.

When the one-row-per-key side is derived from the many-rows side (features
of its distinct domains, split labels of its distinct groups), AQE cannot
split a hot key: that side reaches the join without a shuffle of its own.
So hot keys are split out explicitly:

* ``key_counts`` counts rows per key (partial aggregation before the
  shuffle, and the distinct keys come for free);
* ``hot_keys`` returns the heaviest keys above min(0.1 % of all rows,
  5 x the average rows per shuffle partition), at most 10,000 of them;
* ``split_join`` joins rows of hot keys against a broadcast of the
  one-row-per-key side restricted to those keys (at most 10,000 rows: a
  proven bound) and all other rows through the ordinary shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.001      # above 0.1 % of all rows a key is always hot
SKEW_FACTOR = 5.0      # ... and above 5x the average rows of a shuffle partition
MAX_HOT_KEYS = 10_000  # broadcast bound: the heaviest 10,000 keys at most


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key (``n``); one partial + final aggregation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, keys: Sequence[str], share: float = HOT_SHARE,
             total: int | None = None, partitions: int | None = None,
             max_keys: int = MAX_HOT_KEYS) -> list[tuple]:
    """The heaviest keys (at most ``max_keys``) whose row count exceeds
    min(``share`` of all rows, ``SKEW_FACTOR`` x the average rows per shuffle
    partition).  ``counts`` is read twice when ``total`` is not given: pass a
    checkpointed relation."""
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    if partitions is None:
        partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    threshold = min(total * share, SKEW_FACTOR * total / max(partitions, 1))
    rows = counts.where(F.col("n") > F.lit(threshold)).orderBy(F.desc("n")).limit(max_keys).collect()
    return [tuple(r[k] for k in keys) for r in rows]


def _match(keys: Sequence[str], hot: list[tuple]):
    """One IN predicate (a hash-set lookup) over the key or the key struct."""
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([v[0] for v in hot]), F.lit(False))
    probe = F.struct(*[F.col(k) for k in keys])
    values = [F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, v)]) for v in hot]
    return F.coalesce(probe.isin(values), F.lit(False))


def split_join(many: DataFrame, one: DataFrame, keys: Sequence[str], hot: list[tuple],
               how: str = "left") -> DataFrame:
    """``many`` join ``one`` on ``keys`` (``one`` has one row per key), with
    hot keys served by a broadcast of their ``one`` rows."""
    keys = list(keys)
    if not hot:
        return many.join(one, keys, how)
    is_hot = _match(keys, hot)
    cold = many.where(~is_hot).join(one.where(~is_hot), keys, how)
    warm = many.where(is_hot).join(F.broadcast(one.where(is_hot)), keys, how)
    return cold.unionByName(warm)

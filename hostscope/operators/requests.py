"""Request-shaped operators (P11, P13): validating submitted batches and
aligning feature rows to a model's column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostscope.functions import lists
from hostscope.functions.host import reject_reason


class EmptyBatchError(ValueError):
    """Raised for an empty batch or one without any valid line."""


def split_valid(df: DataFrame, col: str = "domain") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with a ``reason``)."""
    tagged = df.withColumn("reason", reject_reason(col))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def require_valid(df: DataFrame, col: str = "domain") -> DataFrame:
    """P11 error cases of the batch endpoint: an empty batch, or a batch
    where no line is valid, is an error; otherwise the valid rows."""
    ok, _ = split_valid(df, col)
    if df.isEmpty():
        raise EmptyBatchError("empty batch")
    if ok.isEmpty():
        raise EmptyBatchError("no line of the batch is a URL or a domain")
    return ok


def align_features(df: DataFrame, order: Sequence[str] = lists.FEATURE_ORDER, keep: Sequence[str] = ()) -> DataFrame:
    """The model columns in order; a missing column becomes 0."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(0).alias(c) for c in order]
    return df.select(*[F.col(k) for k in keep], *cols)

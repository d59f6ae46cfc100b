"""Connected components of a link table, by alternating star contractions.

Each round hangs every vertex and its neighbours under the smallest vertex it
knows; long chains shrink by a factor per round, so the rounds grow with the
logarithm of the longest path.  A round is two aggregations and two equi-joins;
no neighbour list is collected, so a vertex with very many links is one row per
link everywhere and only its minimum is aggregated (map side first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostscope.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        moved.unionByName(low.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs, neither null -> ``(vertex, component)`` for all
    vertices that are not the smallest of their component; ``component`` is that
    smallest vertex.  Self links and repeated links change nothing; an empty
    table gives an empty result."""
    edges = stored(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    last = _state(edges)
    while last[0]:
        before, edges = edges, stored(_small_star(_large_star(edges)), "stars")
        discard(before)
        now = _state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))

"""Approximate nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected to ``M`` dimensions by a Gaussian (2-stable) matrix:
for a pair at distance d, the squared projected distance is d^2 times a
chi-square variable with M degrees of freedom.  A kd-tree over the projections
(fitted on at most ``SAMPLE`` rows) deals all rows into cells; a cell is a Spark
group with its own small tree.  A query visits projected neighbours in order of
their distance and verifies them on the original vectors, until the chi-square
test holds: a row nearer than the present k-th neighbour would have been met with
probability ``CONFIDENCE`` already.

The search runs in two rounds.  The first visits each query's own cell and gives
a bound for its k-th distance; the second visits the other cells that the bound
and the test cannot exclude by the cell's bounding box.  Cells with many rows are
split into shards by id, so no group grows with the data.

Equal vectors are indexed once, with their k + 1 smallest ids: with ties to the
smaller id no other copy can be a result, so a vector that a third of the rows
share costs one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostscope.llm import common as C

M = 10
CONFIDENCE = 0.98
SAMPLE = 20_000
CELL_ROWS = 4_096
MAX_CELLS = 4_096
LEAF = 32
SEED = 20_240_917


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square with m (even) degrees of freedom <= x) = p."""
    def cdf(x):
        terms, term = 0.0, 1.0
        for i in range(m // 2):
            term = term * (x / 2) / i if i else 1.0
            terms += term
        return 1 - np.exp(-x / 2) * terms

    lo, hi = 0.0, 10.0 * m
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, m))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with many, in double precision; a fixed order of
    additions, so equal vectors have equal scores."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


class KdTree:
    """Median splits of points, by the widest dimension; leaves in order."""

    def __init__(self, points: np.ndarray, leaf: int, most: int = 1 << 30):
        self.leaves: list[np.ndarray] = []
        self.nodes: list[tuple] = []  # (dimension, value, left, right) or leaf number
        depth = 0
        while (1 << depth) < most and len(points) >> depth > leaf:
            depth += 1
        self._build(points, np.arange(len(points)), depth)

    def _build(self, points, rows, depth) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        spread = np.ptp(points[rows], 0) if len(rows) else np.zeros(1)
        if depth == 0 or len(rows) < 2 or not spread.max() > 0:
            self.nodes[at] = (len(self.leaves),)
            self.leaves.append(rows)
            return at
        d = int(spread.argmax())
        value = float(np.median(points[rows, d]))
        left = points[rows, d] < value
        if not left.any():  # the median is the least value
            left = points[rows, d] <= value
            value = float(np.nextafter(value, np.inf))
        a = self._build(points, rows[left], depth - 1)
        b = self._build(points, rows[~left], depth - 1)
        self.nodes[at] = (d, value, a, b)
        return at

    def cell(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if len(self.nodes[node]) == 1:
                out[rows] = self.nodes[node][0]
            elif len(rows):
                d, value, a, b = self.nodes[node]
                left = points[rows, d] < value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def _stack(column, dtype=np.float64) -> np.ndarray:
    return np.array(list(column), dtype=dtype)


class _Cell:
    """The rows of one group, searchable in order of projected distance."""

    def __init__(self, vectors: np.ndarray, proj: np.ndarray, quantile: float):
        points = unit(vectors) @ proj
        tree = KdTree(points, LEAF)
        order = np.concatenate(tree.leaves)
        self.order, self.vectors, self.points, self.quantile = order, vectors[order], points[order], quantile
        sizes = np.array([len(x) for x in tree.leaves])
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        keep = sizes > 0
        self.start = np.concatenate([self.start[:-1][keep], self.start[-1:]])
        self.low = np.minimum.reduceat(self.points, self.start[:-1])
        self.high = np.maximum.reduceat(self.points, self.start[:-1])

    def search(self, q: np.ndarray, point: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of up to k neighbours with squared distance below
        ``bound`` or as good; incremental by leaves."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        leaf_gap = (gap * gap).sum(1)
        leaves = np.argsort(leaf_gap, kind="stable")
        rows, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(leaves):
            take = leaves[at : at + step]
            # the test: leaves beyond this cannot hold a nearer row, with CONFIDENCE
            take = take[leaf_gap[take] <= self.quantile * bound + 1e-12]
            if not len(take):
                break
            new = np.concatenate([np.arange(self.start[x], self.start[x + 1]) for x in take])
            apart = ((self.points[new] - point) ** 2).sum(1)
            new = new[apart <= self.quantile * bound + 1e-12]
            rows = np.concatenate([rows, new])
            score = np.concatenate([score, cosine(q, self.vectors[new])])
            if len(rows) > k:
                kth = -np.partition(-score, k - 1)[k - 1]
                good = score >= kth  # ties stay
                rows, score = rows[good], score[good]
                bound = min(bound, max(0.0, 2 - 2 * kth))
            at, step = at + step, step * 2
        return self.order[rows], score


NOTHING = pd.DataFrame({"qkey": pd.Series(dtype="int64"), "q": pd.Series(dtype="object"),
                        "ids": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})
FOUND = "qkey long, q array<float>, ids array<long>, score double"


def _search(proj: np.ndarray, quantile: float, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return NOTHING
        cell = _Cell(_stack(rows["vector"]), proj, quantile)
        ids = rows["ids"].to_numpy()
        vectors = _stack(queries["q"])
        points = unit(vectors) @ proj
        out = []
        for i, (qkey, q, bound) in enumerate(zip(queries["qkey"], queries["q"], queries["bound"])):
            at, score = cell.search(vectors[i], points[i], k, float(bound))
            out += [(qkey, q, ids[a], s) for a, s in zip(at, score)]
        return pd.DataFrame(out, columns=["qkey", "q", "ids", "score"]) if out else NOTHING

    return run


def nearest(
    rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
    m: int = M, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by
    ``every``, its ``k`` nearest of all other rows by cosine, nearest first, ties
    to the smaller id.

    Vectors that are null, zero, or hold a null, NaN or infinite component take no
    part, nor do rows without id, nor vectors of another length than the most
    frequent one (ties: the shorter).  Identical rows count once; a query never
    finds rows of its own id.  Fewer than ``k`` candidates give fewer rows, an
    empty table none.  Other columns are ignored.
    """
    spark = rows.sparkSession
    C.python_ready(spark)
    vector = F.col("vector")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    clean = clean.where(
        F.col("id").isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0))
    sizes = clean.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim = sizes[0].dim
    # -0.0 and 0.0 are one value
    clean = clean.where(F.size("vector") == dim).select("id", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    clean = clean.withColumn("vkey", F.xxhash64("vector"))

    # equal vectors once, with their k + 1 smallest ids (limited before the shuffle)
    first = Window.partitionBy("vkey", "vector").orderBy("id")
    few = clean.select("vkey", "vector", "id", F.dense_rank().over(first).alias("r")).where(F.col("r") <= k + 1)
    index = C.stored(few.groupBy("vkey", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    queries = C.stored(clean.where(F.col("id") % every == 0).select("id", "vkey", "vector").distinct(), "queries")

    proj = projection(dim, m)
    n = index.count()
    share = min(1.0, SAMPLE / n)
    sample = index.where(F.pmod(F.xxhash64("vkey", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = sample.select("vkey", "vector").orderBy("vkey").limit(2 * SAMPLE).collect()
    points = unit(_stack([r.vector for r in sample])) @ proj
    cells = max(1, min(MAX_CELLS, -(-n // cell_rows), len(points) // 16 or 1))
    tree = KdTree(points, 1, cells)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.cell(unit(_stack(v)) @ proj))

    @F.pandas_udf("array<double>")
    def projected(v: pd.Series) -> pd.Series:
        return pd.Series(list(unit(_stack(v)) @ proj))

    dealt = C.stored(index.withColumn("cell", cell_of("vector")).withColumn("p", projected("vector")), "cells")
    # one row per cell: its size and bounding box
    boxes = dealt.groupBy("cell").agg(
        F.count("*").alias("n"),
        *[F.min(F.col("p")[j]).alias(f"lo{j}") for j in range(m)], *[F.max(F.col("p")[j]).alias(f"hi{j}") for j in range(m)]).collect()
    shards = {r.cell: -(-r.n // (2 * cell_rows)) for r in boxes}
    low = np.array([[r[f"lo{j}"] for j in range(m)] for r in boxes])
    high = np.array([[r[f"hi{j}"] for j in range(m)] for r in boxes])
    numbers = np.array([r.cell for r in boxes])
    quantile = chi_square_quantile(confidence, m)
    shard_of = F.create_map(*[F.lit(x) for c in shards for x in (c, shards[c])])

    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vkey", F.lit(9)), F.element_at(shard_of, F.col("cell")))).select(
        "cell", "shard", "vector", "ids")
    asked = queries.select("vkey", "vector").distinct().select(
        F.xxhash64("vkey", "vector").alias("qkey"), F.col("vector").alias("q"))

    def visit(where: DataFrame) -> DataFrame:
        """(qkey, q, bound, cells) -> found rows, in the given cells."""
        spread = where.withColumn("cell", F.explode("cells")).withColumn(
            "shard", F.explode(F.sequence(F.lit(0), F.element_at(shard_of, F.col("cell")) - 1).cast("array<bigint>")))
        return C.stored(
            dealt.groupBy("cell", "shard").cogroup(
                spread.select("cell", "shard", "qkey", "q", "bound").groupBy("cell", "shard")
            ).applyInPandas(_search(proj, quantile, k + 1), FOUND), "found")

    @F.pandas_udf("array<int>")
    def own_cell(v: pd.Series) -> pd.Series:
        points = unit(_stack(v)) @ proj
        return pd.Series([[int(numbers[_gaps(p, low, high).argmin()])] for p in points])

    @F.pandas_udf("array<int>")
    def other_cells(v: pd.Series, bound: pd.Series) -> pd.Series:
        points, out = unit(_stack(v)) @ proj, []
        for p, b in zip(points, bound):
            gap = _gaps(p, low, high)
            out.append(numbers[(gap <= quantile * b + 1e-12) & (np.arange(len(gap)) != gap.argmin())].tolist())
        return pd.Series(out)

    one = visit(asked.select("qkey", "q", F.lit(4.0).alias("bound"), own_cell("q").alias("cells")))
    # the (k + 1)-th best score so far bounds the distance
    by_score = Window.partitionBy("qkey").orderBy(F.desc("score"))
    kth = one.select("qkey", "score", F.row_number().over(by_score).alias("r")).where(F.col("r") == k + 1)
    kth = kth.select("qkey", F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("bound"))
    bounded = asked.join(kth, "qkey", "left").select("qkey", "q", F.coalesce("bound", F.lit(4.0)).alias("bound"))
    two = visit(bounded.select("qkey", "q", "bound", other_cells("q", "bound").alias("cells")))

    found = one.unionByName(two).select("qkey", "q", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.dense_rank().over(top)).where(F.col("r") <= k + 1).select("qkey", "score", "vec_id").distinct()
    named = queries.select("id", F.xxhash64("vkey", "vector").alias("qkey"))
    last = Window.partitionBy("id", "qkey").orderBy(F.desc("score"), "vec_id")
    return (
        named.join(found, "qkey").where("vec_id <> id").withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _gaps(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(1)

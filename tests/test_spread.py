"""Rows of a small file are dealt over tasks before costly columns, and stay the same rows."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hostscope.operators import features as FT
from hostscope.plans import derived as DV
from hostscope.plans.tree_queries import tree_split_gains
from hostscope.session import TASK_ROWS, spread


def _tables(folder: str, rows: int) -> str:
    keys = [None if i % 997 == 0 else i // 2 for i in range(rows)]  # null and repeated keys
    pq.write_table(pa.table({
        "p_partkey": pa.array(keys, pa.int64()), "p_name": [None if i % 501 == 0 else f"big red {i % 7}" for i in range(rows)],
        "p_size": pa.array([i % 50 + 1 for i in range(rows)], pa.int32())}), f"{folder}/part.parquet", row_group_size=rows)
    pq.write_table(pa.table({
        "page_id": pa.array(keys, pa.int64()), "url": [None if i % 503 == 0 else f"http://h{i % 11}.example.com/{i}" for i in range(rows)],
        "html": [None] * rows}, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])),
        f"{folder}/pages.parquet", row_group_size=rows)
    return folder


def _largest(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_hosts_of_one_file_are_dealt_over_tasks(spark, tmp_dir):
    rows = 2 * TASK_ROWS + 5_000
    sf = _tables(tmp_dir, rows)
    for relation, parts in ((DV.spark_domains, 1), (DV.spark_labelled, 1), (DV.spark_urls, 2)):
        df = relation(spark, sf)
        assert df.count() == parts * rows
        assert _largest(df) <= TASK_ROWS


def test_dealt_rows_are_the_same_rows(spark, tmp_dir):
    sf = _tables(tmp_dir, TASK_ROWS + 1)
    plain = DV.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.expr(DV.gen_domain("p_partkey", "p_name", "p_size", "spark")).alias("domain"))
    dealt = DV.spark_domains(spark, sf)
    assert dealt.exceptAll(plain).count() == 0 and plain.exceptAll(dealt).count() == 0


def test_small_table_stays_as_it_is(spark, tmp_dir):
    df = spark.range(100).coalesce(1)
    assert spread(df) is df and spread(df, 40).rdd.getNumPartitions() == 3
    assert spread(df.where("id < 0")).count() == 0


def test_gains_do_not_depend_on_the_deal(spark, tmp_dir, monkeypatch):
    sf = _tables(tmp_dir, 3_000)
    once = sorted(map(tuple, tree_split_gains(spark, sf).collect()))
    monkeypatch.setattr(DV, "spread", lambda df: spread(df, 400))
    assert sorted(map(tuple, tree_split_gains(spark, sf).collect())) == once and len(once) > 4


def test_filters_run_after_the_deal(spark, tmp_dir):
    lab = DV.spark_labelled(spark, _tables(tmp_dir, TASK_ROWS + 1))
    plan = lab.where("label = 'phishing'")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert "md5(" in above and "md5(" not in below


def test_splits_read_only_the_features_that_split(spark):
    """The cost of a feature no tree splits on, such as the entropy, is not paid."""
    from hostscope.operators import boosting as B
    from hostscope.plans import tree_queries as T

    rows = FT.with_host_features(spark.createDataFrame(
        [("login-amaz0n.example.com", "phishing"), ("a.b.org", "legitimate")], "domain string, label string"), "domain")
    splits = B.measured_splits(rows, T.GIVEN, F.col("label") == "phishing")
    plan = splits._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "log2" not in plan.lower() and "split(" in plan
    shares = {r.feature: r.importance for r in B.average_gain(splits, T.GIVEN.features).collect()}
    assert list(sorted(shares)) == sorted(T.GIVEN.features) and shares["entropy"] == 0 and abs(sum(shares.values()) - 1) < 1e-9


def test_splits_are_measured_by_one_walk_of_a_task(spark):
    """Nulls go left, NaN goes right, a null label has no gradient; places are added up
    in the tasks, so rows are not expanded by trees and levels."""
    from hostscope.operators.boosting import BoostedTrees, Node, measured_splits

    trees = BoostedTrees(["a", "b"], [
        Node(0, 0, "a", 1.0, 0.0, 0.0, 0.0), Node(0, 1, None, None, 0.5, 0.0, 0.0), Node(0, 2, "b", 0.0, 0.0, 0.0, 0.0),
        Node(0, 5, None, None, -0.25, 0.0, 0.0), Node(0, 6, None, None, 1.0, 0.0, 0.0),
        Node(1, 0, None, None, 2.0, 0.0, 0.0), Node(2, 0, "b", -1.0, 0.0, 0.0, 0.0), Node(2, 1, None, None, 0.0, 0.0, 0.0),
        Node(2, 2, None, None, 0.0, 0.0, 0.0)], 0.1)
    given = [(None, 1.0, True), (float("nan"), 0.0, False), (2.0, None, True), (2.0, 5.0, None), (0.0, -3.0, False)] * 7
    rows = spark.createDataFrame(given, "a double, b double, y boolean").repartition(3)
    out = measured_splits(rows, trees, F.col("y"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    got = {(r.tree, r.node): (r.feature, r.n, r.gain) for r in out.collect()}

    import math

    above = lambda x, t: x is not None and (math.isnan(x) or x > t)
    sums: dict = {}
    for a, b, y in given:
        margin = 0.0
        for tree in range(3):
            p = 1 / (1 + math.exp(-(0.1 + margin)))
            g, h = (0.0 if y is None else p - y), p * (1 - p)

            def visit(node, right):
                s = sums.setdefault((tree, node), [0, 0.0, 0.0, 0.0, 0.0])
                s[0], s[1 + 2 * right], s[2 + 2 * right] = s[0] + 1, s[1 + 2 * right] + g, s[2 + 2 * right] + h

            if tree == 0:
                visit(0, above(a, 1.0))
                if above(a, 1.0):
                    visit(2, above(b, 0.0))
                    margin += 1.0 if above(b, 0.0) else -0.25
                else:
                    margin += 0.5
            elif tree == 1:
                margin += 2.0
            else:
                visit(0, above(b, -1.0))
    assert set(got) == set(sums)
    score = lambda g, h: g * g / (h + 1.0)
    for key, (n, gl, hl, gr, hr) in sums.items():
        assert got[key][1] == n and math.isclose(
            got[key][2], score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr), rel_tol=1e-9, abs_tol=1e-12)


def test_brand_distance_equals_the_plain_one(spark):
    """One step for a batch of texts and all brands, not a comparison for each."""
    from hostscope.functions import lists
    from hostscope.operators import features as FT

    texts = [None, "", "a", "GOOGLE", "g00gle", "secure-paypal", "аpple", "\U0001d4b3google", "x" * 300, *lists.KNOWN_BRANDS]
    texts += [b[1:] + "q" + b[:i] for b in lists.KNOWN_BRANDS for i in range(4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for brands in (lists.KNOWN_BRANDS, lists.NOTEBOOK_BRANDS_2, ["é", "b" * 40, "c" * 64, "", "d" * 70]):
        out = FT.min_brand_distance("t", brands)
        both = df.select("t", F.least(*FT.brand_distances("t", brands)).alias("plain"), out.alias("got"))
        assert both.where("NOT plain <=> got").collect() == []
    plan = df.select(FT.min_brand_distance("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan


def test_levels_of_the_fit_have_few_tasks(spark, monkeypatch):
    """Each of a hundred short jobs would have a task for every part of the features."""
    from hostscope.operators import model as M

    seen = []

    class Pipe:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(M, "build_pipeline", lambda s: Pipe())
    few = 3 * spark.sparkContext.defaultParallelism
    rows = spark.range(1_000).selectExpr("double(id) AS a", "'x' AS label")
    for parts in (2, 5 * few):
        M.fit(rows.repartition(parts), M.TreeSettings(features=["a"]))
    assert seen == [(2, 1_000), (few, 1_000)]
    assert M.fit_tasks(spark, 100 * few * M.FIT_ROWS) == 100 * few

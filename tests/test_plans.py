"""Plan-shape regressions: the properties that matter at cluster scale."""

import re

import __spark_entry__ as e

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_narrow_stage(spark):
    plan = _plan(e.queries()["host_features"](spark, SF))
    assert not re.search(r"Exchange (hash|range)partitioning|Exchange SinglePartition", plan)
    assert plan.count("BroadcastHashJoin") == 4
    # pages is read for page_id and url only, never the html column
    assert re.search(r"ReadSchema: struct<page_id:bigint,url:string>", plan)


def test_history_is_top_k_not_full_sort(spark):
    plan = _plan(e.queries()["scan_history"](spark, SF))
    assert "rangepartitioning" not in plan


def test_metrics_scan_once(spark):
    for name in ("class_metrics", "weighted_metrics", "confusion_matrix"):
        plan = _plan(e.queries()[name](spark, SF))
        assert plan.count("FileScan parquet") == 1, name


def test_dedupe_aggregates_before_shuffle(spark):
    plan = _plan(e.queries()["dedupe_first"](spark, SF))
    assert "partial_min_by" in plan


def test_sampling_has_no_unpartitioned_window(spark):
    for name in ("balance_downsample", "stratified_split"):
        plan = _plan(e.queries()[name](spark, SF))
        assert "Window" not in plan and "SinglePartition" not in plan, name

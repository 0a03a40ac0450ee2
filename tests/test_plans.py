"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwise import registry
from shelfwise.plans import analysis, evaluation, features, warehouse
from shelfwise.registry import inputs

registry.load_all()
CHEAP = ["features_v3", "baseline_metrics", "forward_features", "weekly_trend", "stock_count_relationship",
         "hourly_explode", "product_profile", "gate_check_constraints", "gate_foreign_keys"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_and_no_single_task_window(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "EvalPython" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text
    # A window over everything would be fed by an exchange into one partition.
    for before, after in zip(text.splitlines(), text.splitlines()[1:]):
        if "Window [" in before:
            assert "SinglePartition" not in after
    assert not re.search(r"Window \[.*windowspecdefinition\(dt", text)


def test_features_reuse_the_panel_partitioning(spark, sf_dir):
    """Cells, then series: the windows add a sort but no further shuffle."""
    text = plan(features.features_v3(inputs.staging(spark, sf_dir)))
    assert exchanges(text) == ["hashpartitioning", "hashpartitioning"]
    assert len(re.findall(r"\bWindow \[", text)) == 1


def test_forward_features_need_no_window(spark, sf_dir):
    text = plan(features.forward_features(inputs.staging(spark, sf_dir), "2024-07-02"))
    assert "Window" not in text and exchanges(text) == ["hashpartitioning", "hashpartitioning"]


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(registry.QUERIES["scan_projection"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_quantity,45.0\)", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_suppkey", "l_quantity", "l_shipdate"}


def test_panel_without_hours_does_not_touch_the_order_key(spark, sf_dir):
    assert "l_orderkey" not in plan(inputs.staging(spark, sf_dir))
    assert "l_orderkey" in plan(warehouse.hourly(inputs.raw_hourly(spark, sf_dir)))


def test_aggregates_combine_before_the_shuffle(spark, sf_dir):
    for df in (analysis.daily_network(inputs.train(spark, sf_dir)), analysis.weekly_trend(inputs.train(spark, sf_dir))):
        assert "partial_sum(sale_amount" in plan(df)


def test_period_filter_stays_above_the_windows(spark, sf_dir):
    """A date filter below the windows would cut off the holdout's history."""
    text = plan(evaluation.holdout_rows(features.features_v2(inputs.staging(spark, sf_dir))))
    lines = text.splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    assert any("Filter" in line and "dt#" in line for line in lines[:window])
    assert not any("Filter" in line and "dt#" in line for line in lines[window:])


def test_written_dimension_is_broadcast_by_its_size_only(spark, sf_dir):
    from shelfwise.sources.storage import written

    stage = inputs.staging(spark, sf_dir)
    products, dates = written(warehouse.dim_product(stage), "p"), written(warehouse.dim_date(stage), "d")
    joined = warehouse.star_join(inputs.fact(spark, sf_dir), products, dates).select(F.sum("sale_amount"))
    assert plan(joined).count("BroadcastHashJoin") == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        joined = warehouse.star_join(inputs.fact(spark, sf_dir), products, dates).select(F.sum("sale_amount"))
        assert "BroadcastHashJoin" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

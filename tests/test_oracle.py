"""Registered queries against DuckDB on the smallest tables.

A cross-section by default; SHELFWISE_ALL_ORACLES=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, kind, normal
from shelfwise import registry

SAMPLE = """
network_summary daily_network trailing_calendar_mean percent_of_total stockout_bands top_cv_series
intermittency_bands weekend_uplift_pivot discount_distribution top_sales_days product_cv_distribution weather_corr_daily
pct_rank_avg dim_store dim_date hourly_explode star_join warehouse_gates duplicate_profile describe_sales
stockout_sales_profile population_compare features_v3 temporal_splits forward_features feature_parity
baseline_metrics error_by_demand_band kpi_accuracy dedup_load_guard source_registry_changes reconcile_bag_diff
evaluation_import run_audit_latest scenario_sample scenario_supplier budget_sensitivity control_tower
control_tower_gates publish_snapshot bi_forecast_outlook kpi_counts kpi_budget_context series_detail_by_store
scalar_hash scalar_dates decision_reconciliation_perturbed evaluation_load cardinality_sketches integer_columns event_days_summary
""".split()
ORACLES = entry_points.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("SHELFWISE_ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_deterministic_query_has_an_oracle():
    without = {n for n in registry.QUERIES if n not in ORACLES}
    assert without == {"train_gbt", "train_gbt_v1", "train_gbt_v2", "train_gbt_v3", "ablation", "holdout_evaluation",
                       "predict_clip", "next_day_forecast_gbt", "model_registry"}
    assert set(SAMPLE) <= set(ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, sf_dir, db, name):
    df = entry_points.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cur = db.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = [tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()]
    for i, c in enumerate(cols):
        assert {kind(r[i]) for r in got} - {"null"} == {kind(r[i]) for r in want} - {"null"}, c
    assert sorted(tuple(map(normal, r)) for r in got) == sorted(tuple(map(normal, r)) for r in want)

"""Baseline evaluation, diagnostics and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans import evaluation as e
from shelfwise.plans import features as f
from shelfwise.registry import inputs, query
from shelfwise.registry.oracle import oracle
from shelfwise.schemas import DAILY_KEY

METRICS = """count(*) AS rows, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse,
       sum(abs(a - p)) / nullif(sum(abs(a)), 0) AS wape"""
HOLDOUT = "features WHERE history_count_28 = 28 AND dt BETWEEN DATE '2024-06-26' AND DATE '2024-07-02'"


def _v2(s, d):
    return f.features_v2(inputs.staging(s, d))


def _errors(s, d):
    return e.error_rows(e.holdout_rows(_v2(s, d)), "target_sale_amount", "sales_rolling_mean_7")


ERRORS = f"""(SELECT *, target_sale_amount AS actual, sales_rolling_mean_7 AS prediction,
  sales_rolling_mean_7 - target_sale_amount AS signed_error,
  abs(sales_rolling_mean_7 - target_sale_amount) AS absolute_error FROM {HOLDOUT})"""

query("baseline_metrics", oracle("SELECT model, " + METRICS + " FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, target_sale_amount AS a, {c} AS p FROM {HOLDOUT}"
    for m, c in (("lag_1", "sales_lag_1"), ("lag_7", "sales_lag_7"), ("rolling_mean_7", "sales_rolling_mean_7"))
) + ") GROUP BY model", "mae rmse wape"))(
    lambda s, d: e.baseline_metrics(_v2(s, d)))

query("error_diagnostics", oracle(
    f"SELECT store_id, product_id, dt, actual, prediction, signed_error, absolute_error FROM {ERRORS}",
    "actual prediction signed_error absolute_error", "dt"))(
    lambda s, d: _errors(s, d).select(*DAILY_KEY, "actual", "prediction", "signed_error", "absolute_error"))

query("forecast_direction", oracle(f"""
SELECT avg(CASE WHEN signed_error < 0 THEN 1e0 ELSE 0e0 END) AS underforecast_rate,
       avg(CASE WHEN signed_error > 0 THEN 1e0 ELSE 0e0 END) AS overforecast_rate,
       avg(CASE WHEN signed_error = 0 THEN 1e0 ELSE 0e0 END) AS exact_rate FROM {ERRORS}""",
    "underforecast_rate overforecast_rate exact_rate"))(
    lambda s, d: e.forecast_direction(_errors(s, d)))

_BY = "count(*) AS observations, avg(actual) AS actual_mean, avg(absolute_error) AS mae"
query("error_by_weekend", oracle(f"SELECT is_weekend, {_BY} FROM {ERRORS} GROUP BY 1", "actual_mean mae"))(
    lambda s, d: e.error_by_weekend(_errors(s, d)))
query("error_by_demand_band", oracle(f"""
SELECT CASE WHEN actual <= 0 THEN 'Zero' WHEN actual <= 0.5 THEN '0-0.5' WHEN actual <= 1 THEN '0.5-1.0'
            WHEN actual <= 2 THEN '1.0-2.0' ELSE '>2.0' END AS demand_band, {_BY} FROM {ERRORS} GROUP BY 1""",
    "actual_mean mae"))(
    lambda s, d: e.error_by_demand_band(_errors(s, d)))
query("error_by_stockout_band", oracle(f"""
SELECT CASE WHEN stockout_rolling_mean_7 <= 0 THEN 'No recent stockout' WHEN stockout_rolling_mean_7 <= 4 THEN '0-4 hours'
            WHEN stockout_rolling_mean_7 <= 8 THEN '4-8 hours' ELSE '>8 hours' END AS stockout_band, {_BY}
FROM {ERRORS} GROUP BY 1""", "actual_mean mae"))(
    lambda s, d: e.error_by_stockout_band(_errors(s, d)))

query("eval_vs_actual_mismatch", oracle("""
SELECT count(*) AS rows, count(*) FILTER (WHERE f.sale_amount IS NULL) AS missing,
       count(*) FILTER (WHERE abs(v.actual - f.sale_amount) > 1e-7) AS different
FROM evaluation v LEFT JOIN fact f ON f.store_id = v.store_id AND f.product_id = v.product_id AND f.dt = v.dt"""))(
    lambda s, d: e.actual_mismatch(e.rolling_evaluation(_v2(s, d)), inputs.fact(s, d)))

query("kpi_accuracy", oracle(
    f"SELECT CAST(dt AS VARCHAR) AS dt, {METRICS} FROM (SELECT dt, actual AS a, prediction AS p FROM evaluation) GROUP BY dt"
    f" UNION ALL SELECT 'all' AS dt, {METRICS} FROM (SELECT dt, actual AS a, prediction AS p FROM evaluation)",
    "mae rmse wape"))(
    lambda s, d: _accuracy(s, d))


def _accuracy(s, d):
    """Daily metrics and the overall ones from one pass (rollup)."""
    rows = e.rolling_evaluation(_v2(s, d))
    m = [F.count(F.lit(1)).alias("rows"), *e.metrics(F.col("actual"), F.col("prediction"))]
    return rows.rollup(F.col("dt").cast("string").alias("day")).agg(*m).select(
        F.coalesce("day", F.lit("all")).alias("dt"), "rows", "mae", "rmse", "wape")

"""BI measure queries over the published mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans import evaluation as e
from shelfwise.plans import features as f
from shelfwise.plans import kpi as k
from shelfwise.plans import warehouse as w
from shelfwise.registry import chain, inputs, query
from shelfwise.registry.decision_queries import _OUTLOOK_SQL, outlook
from shelfwise.registry.oracle import oracle
from shelfwise.sources.storage import written

BY = "control_tower_status"


def _mart(s, d):
    return chain.published(s, d)[1]


_COUNTS = {
    "total_series": "TRUE", "reorder_required": "reorder_required",
    "healthy_series": f"{BY} = 'HEALTHY'", "watch_series": f"{BY} = 'WATCH'",
    "critical_cases": f"{BY} LIKE 'CRITICAL%'", "funded_orders": "allocated_quantity > 0",
    "unfunded_reorders": "reorder_required AND allocated_quantity = 0",
    "coverage_gap_series": "coverage_gap_days > 0", "capital_constrained": "capital_constrained",
    "capacity_constrained": "capacity_constrained", "shelf_life_constrained": "shelf_life_constrained",
    "high_or_critical_reorders": "urgency_band IN ('HIGH', 'CRITICAL')",
    "action_required": f"{BY} NOT IN ('HEALTHY', 'WATCH')",
    "zero_feasible_reorders": "reorder_required AND final_recommended_quantity = 0", "chart_series": "TRUE",
}
_COUNT_SQL = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _COUNTS.items())
query("kpi_counts", oracle(f"SELECT {_COUNT_SQL} FROM tower"))(
    lambda s, d: k.measure(_mart(s, d), k.count_measures()))
query("kpi_counts_by_store", oracle(f"SELECT store_id, {_COUNT_SQL} FROM tower GROUP BY store_id"))(
    lambda s, d: k.measure(_mart(s, d), k.count_measures(), ["store_id"]))

_SUMS = {
    "allocated_capital": "allocated_order_value", "total_raw_requirement": "raw_order_quantity",
    "total_feasible_quantity": "final_recommended_quantity", "total_allocated_quantity": "allocated_quantity",
    **{c: c for c in ("on_hand_quantity", "on_order_quantity", "inventory_position", "expected_daily_demand",
                      "safety_stock", "reorder_point")},
}
query("kpi_sums", oracle(
    f"SELECT {BY}, " + ", ".join(f"sum({c}) AS {n}" for n, c in _SUMS.items()) + f" FROM tower GROUP BY {BY}",
    " ".join(_SUMS)))(lambda s, d: k.measure(_mart(s, d), k.sum_measures(), [BY]))

query("kpi_row_max_sums", oracle(f"""
SELECT {BY}, sum(greatest(raw_order_quantity - allocated_quantity, 0)) AS unmet_quantity,
       sum(greatest(final_recommended_quantity - allocated_quantity, 0)) AS feasible_unfunded_quantity,
       sum(greatest(raw_order_quantity - final_recommended_quantity, 0)) AS constraint_shortfall_quantity
FROM tower GROUP BY {BY}""", "unmet_quantity feasible_unfunded_quantity constraint_shortfall_quantity"))(
    lambda s, d: k.measure(_mart(s, d), k.row_max_measures(), [BY]))

query("kpi_averages", oracle("""
SELECT product_id, avg(days_of_supply) AS avg_days_of_supply, avg(coverage_gap_days) AS avg_coverage_gap,
       avg(average_lead_time_days) AS avg_lead_time, avg(urgency_score) AS avg_urgency_score
FROM tower GROUP BY product_id""", "avg_days_of_supply avg_coverage_gap avg_lead_time avg_urgency_score"))(
    lambda s, d: k.measure(_mart(s, d), k.average_measures(), ["product_id"]))

_RATIOS = ["reorder_rate", "budget_utilisation", "shared_budget_utilisation", "selection_budget_share",
           "funded_reorder_rate"]
_CONTEXT = ["allocated_capital", "shared_allocated_capital", "scenario_budget", "unused_budget",
            "shared_budget_remaining"]
_BUDGET_SQL = """
SELECT store_id, sum(allocated_order_value) AS allocated_capital, max(t) AS shared_allocated_capital,
       max(budget) AS scenario_budget, max(budget) - sum(allocated_order_value) AS unused_budget,
       max(budget) - max(t) AS shared_budget_remaining,
       count(*) FILTER (WHERE reorder_required) / CAST(count(*) AS DOUBLE) AS reorder_rate,
       sum(allocated_order_value) / max(budget) AS budget_utilisation, max(t) / max(budget) AS shared_budget_utilisation,
       sum(allocated_order_value) / max(budget) AS selection_budget_share,
       count(*) FILTER (WHERE allocated_quantity > 0)
         / CAST(nullif(count(*) FILTER (WHERE reorder_required), 0) AS DOUBLE) AS funded_reorder_rate
FROM tower CROSS JOIN shared_budget CROSS JOIN (SELECT sum(allocated_order_value) AS t FROM tower) GROUP BY store_id"""


def _budget(s, d):
    sc, mart = chain.published(s, d)
    return k.budget_measures(mart, sc.budget, ["store_id"])


query("kpi_ratios", oracle(f"SELECT store_id, {', '.join(_RATIOS)} FROM ({_BUDGET_SQL})", " ".join(_RATIOS)))(
    lambda s, d: _budget(s, d).select("store_id", *_RATIOS))
query("kpi_budget_context", oracle(f"SELECT store_id, {', '.join(_CONTEXT)} FROM ({_BUDGET_SQL})", " ".join(_CONTEXT)))(
    lambda s, d: _budget(s, d).select("store_id", *_CONTEXT))

query("kpi_constraint_switch", oracle(" UNION ALL ".join(
    f'SELECT \'{n}\' AS "constraint", count(*) FILTER (WHERE {c}) AS series FROM tower'
    for n, c in k.CONSTRAINTS.items())))(lambda s, d: k.constraint_counts(_mart(s, d)))


def _mae_improvement(s, d):
    """Rolling mean against yesterday's value on the same holdout rows."""
    rows = e.holdout_rows(f.features_v2(inputs.staging(s, d)))
    a = F.col("target_sale_amount")
    one = rows.agg(e.mae(a, F.col("sales_lag_1")).alias("baseline_mae"),
                   e.mae(a, F.col("sales_rolling_mean_7")).alias("model_mae"), F.count(F.lit(1)).alias("forecast_rows"))
    return one.withColumn("mae_improvement", k.improvement(F.col("baseline_mae"), F.col("model_mae")))


query("kpi_mae_improvement", oracle("""
SELECT *, (baseline_mae - model_mae) / nullif(baseline_mae, 0) AS mae_improvement FROM (
  SELECT avg(abs(target_sale_amount - sales_lag_1)) AS baseline_mae,
         avg(abs(target_sale_amount - sales_rolling_mean_7)) AS model_mae, count(*) AS forecast_rows
  FROM features WHERE history_count_28 = 28 AND dt BETWEEN DATE '2024-06-26' AND DATE '2024-07-02')""",
    "baseline_mae model_mae mae_improvement"))(_mae_improvement)

_NUMBERS = ["predicted_demand", "on_hand_quantity", "on_order_quantity", "backorder_quantity", "inventory_position",
            "days_of_supply", "average_lead_time_days", "coverage_gap_days", "safety_stock", "reorder_point",
            "raw_order_quantity", "final_recommended_quantity", "allocated_quantity"]


def _detail_sql(by: str) -> str:
    def when_one(x: str, other: str) -> str:
        return f"CASE WHEN count(*) = 1 THEN {x} ELSE '{other}' END"

    flag = lambda c: f"CASE WHEN bool_or({c}) THEN 'binding' ELSE 'clear' END"
    nums = ", ".join(f"CASE WHEN count(*) = 1 THEN max({n}) END AS outlook_{n}" for n in _NUMBERS)
    series = "'S' || max(store_id) || ' / SKU ' || max(product_id)"
    bound = (f"'Capital: ' || {flag('capital_constrained')} || ' | Capacity: ' || {flag('capacity_constrained')}"
             f" || ' | Shelf life: ' || {flag('shelf_life_constrained')}"
             " || printf(' | MOQ %.2f', max(minimum_order_quantity)) || printf(' | Pack %.0f', max(case_pack_size))")
    return f"""
SELECT {by}, {when_one(series, k.NO_SERIES)} AS selected_series,
       {when_one('max(recommended_action)', k.NO_SELECTION_ACTION)} AS selected_action,
       max(as_of_date) AS decision_date, {nums},
       CASE WHEN count(*) = 1 THEN CASE WHEN max(urgency_score) IS NULL THEN 'Not ranked'
            ELSE printf('%.2f', max(urgency_score)) END END AS outlook_urgency,
       {when_one("strftime(max(forecast_date), '%d %b %Y')", k.NO_OUTLOOK)} AS outlook_forecast_date,
       {when_one('max(control_tower_status)', k.NO_OUTLOOK)} AS outlook_status,
       {when_one(bound, k.NO_OUTLOOK)} AS outlook_constraints,
       {when_one('max(recommended_action)', k.NO_OUTLOOK_ACTION)} AS outlook_action
FROM ({_OUTLOOK_SQL}) GROUP BY {by}"""


_DETAIL_FLOATS = " ".join(f"outlook_{n}" for n in _NUMBERS)
query("series_detail", oracle(_detail_sql("store_id, product_id"), _DETAIL_FLOATS, "decision_date"))(
    lambda s, d: k.series_detail(outlook(s, d), ["store_id", "product_id"]))
query("series_detail_by_store", oracle(_detail_sql("store_id"), _DETAIL_FLOATS, "decision_date"))(
    lambda s, d: k.series_detail(outlook(s, d), ["store_id"]))

query("display_format", oracle(f"""
SELECT {BY}, format('{{:,}}', count(*)) AS total_series_display,
       format('{{:,}}', count(*) FILTER (WHERE reorder_required)) AS reorder_required_display,
       format('{{:,}}', count(*) FILTER (WHERE reorder_required AND allocated_quantity = 0)) AS unfunded_reorders_display,
       format('{{:,.2f}}', sum(allocated_order_value)) AS allocated_capital_display,
       format('{{:,.2f}}', sum(raw_order_quantity)) AS total_raw_requirement_display
FROM tower GROUP BY {BY}"""))(lambda s, d: k.display_format(_mart(s, d), [BY]))

query("row_visibility", oracle("""
SELECT p.store_id, p.product_id, CASE WHEN t.store_id IS NULL THEN 0 ELSE 1 END AS detail_row_visible,
       CASE WHEN t.control_tower_status NOT IN ('HEALTHY', 'WATCH') THEN 1 ELSE 0 END AS priority_row_visible,
       CASE WHEN t.store_id IS NOT NULL THEN 1 END AS scenario_member_available
FROM profile p LEFT JOIN tower t ON t.store_id = p.store_id AND t.product_id = p.product_id"""))(
    lambda s, d: (lambda p: k.row_visibility(p[0].profiles, p[1], ["store_id", "product_id"]))(chain.published(s, d)))

query("reorder_urgency_label", oracle("""
SELECT reorder_urgency, reorder_urgency_sort, count(*) AS series FROM (
  SELECT CASE WHEN reorder_required THEN coalesce(urgency_band, 'UNCLASSIFIED') ELSE 'NOT REQUIRED' END AS reorder_urgency,
         CASE WHEN NOT reorder_required THEN 5 WHEN urgency_band = 'CRITICAL' THEN 1 WHEN urgency_band = 'HIGH' THEN 2
              WHEN urgency_band = 'MEDIUM' THEN 3 WHEN urgency_band = 'LOW' THEN 4 ELSE 6 END AS reorder_urgency_sort
  FROM tower) GROUP BY 1, 2"""))(
    lambda s, d: k.reorder_urgency(_mart(s, d)).groupBy("reorder_urgency", "reorder_urgency_sort")
    .agg(F.count(F.lit(1)).alias("series")))


def _star(s, d):
    stage = inputs.staging(s, d)
    products = written(w.dim_product(stage), "dim_product")
    stores = written(w.dim_store(stage), "dim_store")
    return k.sliced(_mart(s, d), products, stores, ["first_category_id", "city_id"])


query("star_slicing", oracle("""
SELECT p.first_category_id, s.city_id, count(*) AS series, count(*) FILTER (WHERE t.reorder_required) AS reorders,
       sum(t.allocated_order_value) AS allocated_capital
FROM tower t JOIN dim_product p ON p.product_id = t.product_id JOIN dim_store s ON s.store_id = t.store_id
GROUP BY 1, 2""", "allocated_capital"))(_star)

query("observed_sales", oracle("""
SELECT t.control_tower_status, sum(f.sale_amount) AS observed_sales
FROM fact f JOIN tower t ON f.store_id = t.store_id AND f.product_id = t.product_id
WHERE f.dt <= t.decision_date GROUP BY 1""", "observed_sales"))(
    lambda s, d: (lambda p: p[0].fact.groupBy("store_id", "product_id", "dt").agg(F.sum("sale_amount").alias("sales"))
                  .join(p[1].select("store_id", "product_id", "decision_date", BY), ["store_id", "product_id"])
                  .filter("dt <= decision_date").groupBy(BY).agg(F.sum("sales").alias("observed_sales")))(
        chain.published(s, d)))

"""BI measures over the control tower: aggregates with optional grouping.

A measure is a name and an aggregate. Measures that ignore the grouping (the
shared budget and the like) come from a one-row total attached to each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.schemas import SERIES_KEY

QUIET = ["HEALTHY", "WATCH"]  # fixed values: statuses needing no action
CONSTRAINTS = {"Capital": "capital_constrained", "Capacity": "capacity_constrained",
               "Shelf Life": "shelf_life_constrained"}
NO_SELECTION_ACTION = "Select a single store-product pair to inspect its recommendation."
NO_SERIES = "Choose filters above"
NO_OUTLOOK = "Select one scenario store / product"


def _status() -> Column:
    return F.col("control_tower_status")


def needs_action() -> Column:
    return ~_status().isin(*QUIET)


def count_measures() -> dict[str, Column]:
    c = F.col
    reorder, given = c("reorder_required"), c("allocated_quantity")
    return {
        "total_series": F.count(F.lit(1)),
        "reorder_required": F.count_if(reorder),
        "healthy_series": F.count_if(_status() == "HEALTHY"),
        "watch_series": F.count_if(_status() == "WATCH"),
        "critical_cases": F.count_if(F.substring(_status(), 1, 8) == "CRITICAL"),
        "funded_orders": F.count_if(given > 0),
        "unfunded_reorders": F.count_if(reorder & (given == 0)),
        "coverage_gap_series": F.count_if(c("coverage_gap_days") > 0),
        "capital_constrained": F.count_if(c("capital_constrained")),
        "capacity_constrained": F.count_if(c("capacity_constrained")),
        "shelf_life_constrained": F.count_if(c("shelf_life_constrained")),
        "high_or_critical_reorders": F.count_if(c("urgency_band").isin("HIGH", "CRITICAL")),
        "action_required": F.count_if(needs_action()),
        "zero_feasible_reorders": F.count_if(reorder & (c("final_recommended_quantity") == 0)),
        "chart_series": F.count(F.lit(1)),
    }


def sum_measures() -> dict[str, Column]:
    return {
        "allocated_capital": F.sum("allocated_order_value"),
        "total_raw_requirement": F.sum("raw_order_quantity"),
        "total_feasible_quantity": F.sum("final_recommended_quantity"),
        "total_allocated_quantity": F.sum("allocated_quantity"),
        "on_hand_quantity": F.sum("on_hand_quantity"),
        "on_order_quantity": F.sum("on_order_quantity"),
        "inventory_position": F.sum("inventory_position"),
        "expected_daily_demand": F.sum("expected_daily_demand"),
        "safety_stock": F.sum("safety_stock"),
        "reorder_point": F.sum("reorder_point"),
    }


def _excess(a: str, b: str) -> Column:
    return F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0.0)))


def row_max_measures() -> dict[str, Column]:
    """Sums of per-row shortfalls, so surpluses never net against them."""
    return {
        "unmet_quantity": _excess("raw_order_quantity", "allocated_quantity"),
        "feasible_unfunded_quantity": _excess("final_recommended_quantity", "allocated_quantity"),
        "constraint_shortfall_quantity": _excess("raw_order_quantity", "final_recommended_quantity"),
    }


def average_measures() -> dict[str, Column]:
    return {
        "avg_days_of_supply": F.avg("days_of_supply"),
        "avg_coverage_gap": F.avg("coverage_gap_days"),
        "avg_lead_time": F.avg("average_lead_time_days"),
        "avg_urgency_score": F.avg("urgency_score"),
    }


def measure(tower: DataFrame, measures: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    return tower.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])


def budget_measures(tower: DataFrame, budget: float, by: Sequence[str] = ()) -> DataFrame:
    """Grouped capital next to the shared budget and the ungrouped allocation."""
    groups = measure(tower, {
        "allocated_capital": F.sum("allocated_order_value"),
        "reorders": F.count_if(F.col("reorder_required")),
        "series": F.count(F.lit(1)),
        "funded": F.count_if(F.col("allocated_quantity") > 0),
    }, by)
    total = tower.agg(F.sum("allocated_order_value").alias("shared_allocated_capital"))
    c, full = F.col, F.lit(float(budget))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return groups.crossJoin(F.broadcast(total)).select(
        *by, "allocated_capital", "shared_allocated_capital",
        full.alias("scenario_budget"),
        (full - c("allocated_capital")).alias("unused_budget"),
        (full - c("shared_allocated_capital")).alias("shared_budget_remaining"),
        zero(F.try_divide(c("reorders").cast("double"), c("series"))).alias("reorder_rate"),
        zero(F.try_divide(c("allocated_capital"), full)).alias("budget_utilisation"),
        F.try_divide(c("shared_allocated_capital"), full).alias("shared_budget_utilisation"),
        F.try_divide(c("allocated_capital"), full).alias("selection_budget_share"),
        F.try_divide(c("funded").cast("double"), c("reorders")).alias("funded_reorder_rate"),
    )


def improvement(baseline: Column, model: Column) -> Column:
    return F.try_divide(baseline - model, baseline)


def constraint_counts(tower: DataFrame) -> DataFrame:
    """One row per constraint of a list that has no relation to the facts."""
    one = tower.agg(*[F.count_if(F.col(c)).alias(c) for c in CONSTRAINTS.values()])
    pairs = F.array(*[
        F.struct(F.lit(n).alias("constraint"), F.col(c).alias("series")) for n, c in CONSTRAINTS.items()
    ])
    return one.select(F.inline(pairs))


# Fixed value: shown while no single series is chosen.
NO_OUTLOOK_ACTION = "Choose a store and product to trace the decision."


def only_one(value: Column) -> Column:
    """The value when exactly one row is in context, else NULL."""
    return F.when(F.count(F.lit(1)) == 1, F.max(value))


def series_detail(outlook: DataFrame, by: Sequence[str]) -> DataFrame:
    """Detail cards per selection: filled only when it holds a single series."""
    c = F.col
    single = F.count(F.lit(1)) == 1
    numbers = ["predicted_demand", "on_hand_quantity", "on_order_quantity", "backorder_quantity",
               "inventory_position", "days_of_supply", "average_lead_time_days", "coverage_gap_days",
               "safety_stock", "reorder_point", "raw_order_quantity", "final_recommended_quantity",
               "allocated_quantity"]

    def binding(name: str, label: str) -> Column:
        return F.concat(F.lit(f"{label}: "), F.when(F.bool_or(name), "binding").otherwise("clear"))

    urgency = F.max("urgency_score")
    amounts = [F.format_string("MOQ %.2f", F.max("minimum_order_quantity")), F.format_string("Pack %.0f", F.max("case_pack_size"))]
    key = [F.max(k).cast("string") for k in SERIES_KEY]
    return outlook.groupBy(*by).agg(
        F.when(single, F.concat(F.lit("S"), key[0], F.lit(" / SKU "), key[1])).otherwise(NO_SERIES)
        .alias("selected_series"),
        F.when(single, F.max("recommended_action")).otherwise(NO_SELECTION_ACTION).alias("selected_action"),
        F.max("as_of_date").alias("decision_date"),
        *[only_one(c(n)).alias(f"outlook_{n}") for n in numbers],
        F.when(single, F.when(urgency.isNull(), "Not ranked").otherwise(F.format_number(urgency, 2)))
        .alias("outlook_urgency"),
        F.when(single, F.date_format(F.max("forecast_date"), "dd MMM yyyy")).otherwise(NO_OUTLOOK)
        .alias("outlook_forecast_date"),
        F.when(single, F.max("control_tower_status")).otherwise(NO_OUTLOOK).alias("outlook_status"),
        F.when(single, F.concat_ws(" | ", binding("capital_constrained", "Capital"),
                                   binding("capacity_constrained", "Capacity"),
                                   binding("shelf_life_constrained", "Shelf life"), *amounts))
        .otherwise(NO_OUTLOOK).alias("outlook_constraints"),
        F.when(single, F.max("recommended_action")).otherwise(NO_OUTLOOK_ACTION).alias("outlook_action"),
    )


def display_format(tower: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Measures as text, thousands separated."""
    return measure(tower, {
        "total_series_display": F.format_number(F.count(F.lit(1)), 0),
        "reorder_required_display": F.format_number(F.count_if(F.col("reorder_required")), 0),
        "unfunded_reorders_display": F.format_number(
            F.count_if(F.col("reorder_required") & (F.col("allocated_quantity") == 0)), 0),
        "allocated_capital_display": F.format_number(F.sum("allocated_order_value"), 2),
        "total_raw_requirement_display": F.format_number(F.sum("raw_order_quantity"), 2),
    }, by)


def row_visibility(dimension: DataFrame, tower: DataFrame, key: Sequence[str]) -> DataFrame:
    """Which members of a dimension have decisions, and which need action."""
    seen = tower.groupBy(*key).agg(
        F.lit(1).alias("detail_row_visible"),
        F.max(F.when(needs_action(), 1).otherwise(0)).alias("priority_row_visible"),
    )
    return dimension.select(*key).join(seen, list(key), "left").select(
        *key,
        F.coalesce("detail_row_visible", F.lit(0)).alias("detail_row_visible"),
        F.coalesce("priority_row_visible", F.lit(0)).alias("priority_row_visible"),
        F.col("detail_row_visible").alias("scenario_member_available"),
    )


def reorder_urgency(tower: DataFrame) -> DataFrame:
    """Urgency label and its sort key for slicing."""
    band, reorder = F.col("urgency_band"), F.col("reorder_required")
    order = F.when(~reorder, 5)
    for i, name in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW"), start=1):
        order = order.when(band == name, i)
    return tower.withColumns({
        "reorder_urgency": F.when(reorder, F.coalesce(band, F.lit("UNCLASSIFIED"))).otherwise("NOT REQUIRED"),
        "reorder_urgency_sort": order.otherwise(6),
    })


def sliced(tower: DataFrame, products: DataFrame, stores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Measures by dimension attributes; no broadcast is forced on the dimensions."""
    return (
        tower.join(products, "product_id").join(stores, "store_id").groupBy(*by).agg(
            F.count(F.lit(1)).alias("series"),
            F.count_if(F.col("reorder_required")).alias("reorders"),
            F.sum("allocated_order_value").alias("allocated_capital"),
        )
    )

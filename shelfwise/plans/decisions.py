"""From forecast and scenario to a constrained, scored order per series.

The steps after the one five-way join are column arithmetic, so the whole
chain runs in a single stage; each step returns its input plus new columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ordered import with_grand_total
from shelfwise.schemas import DECISION_KEY, SERIES_KEY

DEMAND_FLOOR = 0.01
# Normal quantile by service level.
Z_SCORES = ((0.99, 2.326), (0.975, 1.960))
Z_DEFAULT = 1.645
# Urgency weights and bands.
WEIGHTS = {"coverage": 0.30, "stockout": 0.20, "demand": 0.15, "unmet": 0.15, "supplier": 0.10, "priority": 0.10}
BANDS = ((70, "CRITICAL"), (50, "HIGH"), (30, "MEDIUM"))
LOWEST_BAND = "LOW"

INVENTORY_DECISION = [
    *DECISION_KEY, "expected_daily_demand", "demand_std", "on_hand_quantity", "on_order_quantity",
    "backorder_quantity", "inventory_position", "supplier_id", "average_lead_time_days",
    "lead_time_std_days", "target_service_level", "planning_horizon_days", "lead_time_demand",
    "safety_stock", "reorder_point", "days_of_supply", "coverage_gap_days", "reorder_required",
    "target_stock_level", "raw_order_quantity", "minimum_order_quantity", "case_pack_size", "unit_cost",
    "working_capital_limit", "warehouse_capacity_remaining", "stockout_cost_per_unit",
    "holding_cost_per_unit_day", "shelf_life_days", "priority_weight",
]
ORDER_RECOMMENDATION = [
    *DECISION_KEY, "reorder_required", "raw_order_quantity", "minimum_order_quantity", "case_pack_size",
    "unconstrained_pack_quantity", "supplier_unit_cost", "unconstrained_order_value", "affordable_quantity",
    "capacity_feasible_quantity", "shelf_life_max_quantity", "final_recommended_quantity",
    "final_order_value", "unmet_requirement_quantity", "capital_constrained", "capacity_constrained",
    "shelf_life_constrained", "recommendation_status", "priority_weight",
]
PRIORITY_SCORED = [
    *DECISION_KEY, "recommendation_status", "final_recommended_quantity", "final_order_value",
    "unmet_requirement_quantity", "expected_daily_demand", "coverage_gap_days", "stockout_cost_per_unit",
    "on_time_delivery_rate", "priority_weight", "urgency_score", "urgency_band",
]


def scenario_join(
    inventory: DataFrame, supplier: DataFrame, priority: DataFrame, profiles: DataFrame, forecast: DataFrame
) -> DataFrame:
    """Inner joins on the series key; only active suppliers.

    Run, model and target date of the forecast travel with the row, so the
    mart's lineage needs no later join.
    """
    predicted = forecast.select(
        *SERIES_KEY, "prediction", "model_id", F.col("run_id").alias("forecast_run_id"),
        F.col("target_date").alias("forecast_target_date"),
    )
    return (
        inventory.join(supplier.filter("active_flag").drop("active_flag"), SERIES_KEY)
        .join(priority, SERIES_KEY)
        .join(profiles.select(*SERIES_KEY, "demand_std"), SERIES_KEY)
        .join(predicted, SERIES_KEY)
    )


def z_score(service: Column) -> Column:
    z = F.when(service >= Z_SCORES[0][0], Z_SCORES[0][1])
    for level, value in Z_SCORES[1:]:
        z = z.when(service >= level, value)
    return z.otherwise(Z_DEFAULT)


def safety_stock(mu: Column, sigma: Column, lead: Column, lead_std: Column, service: Column) -> Column:
    return z_score(service) * F.sqrt(lead * (sigma * sigma) + (mu * mu) * (lead_std * lead_std))


def inventory_decision(joined: DataFrame) -> DataFrame:
    """Safety stock, reorder point, coverage and raw quantity."""
    c = F.col
    mu, lead = c("expected_daily_demand"), c("average_lead_time_days")
    rows = joined.withColumnRenamed("as_of_date", "decision_date").withColumns({
        "expected_daily_demand": F.greatest(c("prediction"), F.lit(DEMAND_FLOOR)),
        "demand_std": F.coalesce(c("demand_std"), F.lit(0.0)),
        "inventory_position": c("on_hand_quantity") + c("on_order_quantity") - c("backorder_quantity"),
    })
    rows = rows.withColumns({
        "lead_time_demand": mu * lead,
        "safety_stock": safety_stock(mu, c("demand_std"), lead, c("lead_time_std_days"), c("target_service_level")),
        "days_of_supply": c("on_hand_quantity") / mu,
    })
    rows = rows.withColumns({
        "reorder_point": c("lead_time_demand") + c("safety_stock"),
        "coverage_gap_days": F.greatest(lead - c("days_of_supply"), F.lit(0.0)),
        "target_stock_level": mu * c("planning_horizon_days") + c("safety_stock"),
    })
    return rows.withColumns({
        "reorder_required": c("inventory_position") <= c("reorder_point"),
        "raw_order_quantity": F.greatest(c("target_stock_level") - c("inventory_position"), F.lit(0.0)),
    })


def _whole_packs(quantity: Column, pack: Column) -> Column:
    return F.floor(quantity / pack).cast("double") * pack


def order_recommendation(decided: DataFrame) -> DataFrame:
    """Round to packs and MOQ, then cap by capital, capacity and shelf life."""
    c = F.col
    pack, cost, moq, raw = (c("case_pack_size"), c("supplier_unit_cost"), c("minimum_order_quantity"),
                            c("raw_order_quantity"))
    wanted = c("unconstrained_pack_quantity")
    rows = decided.withColumn(
        "unconstrained_pack_quantity",
        F.when(c("reorder_required"), F.ceil(F.greatest(raw, moq) / pack).cast("double") * pack).otherwise(0.0),
    )
    no_capital_rule = cost.isNull() | (cost <= 0) | c("working_capital_limit").isNull()
    shelf_room = c("expected_daily_demand") * c("shelf_life_days") - c("inventory_position")
    rows = rows.withColumns({
        "unconstrained_order_value": wanted * cost,
        "affordable_quantity": F.when(no_capital_rule, wanted)
        .otherwise(_whole_packs(F.try_divide(c("working_capital_limit"), cost), pack)),
        "capacity_feasible_quantity": F.when(c("warehouse_capacity_remaining").isNull(), wanted)
        .otherwise(_whole_packs(c("warehouse_capacity_remaining"), pack)),
        "shelf_life_max_quantity": F.when(c("shelf_life_days").isNull(), wanted)
        .otherwise(F.greatest(_whole_packs(shelf_room, pack), F.lit(0.0))),
    })
    caps = [wanted, c("affordable_quantity"), c("capacity_feasible_quantity"), c("shelf_life_max_quantity")]
    smallest = F.least(*caps)
    rows = rows.withColumn(
        "final_recommended_quantity",
        F.when(~c("reorder_required") | (smallest < moq), 0.0).otherwise(F.greatest(smallest, F.lit(0.0))),
    )
    final = c("final_recommended_quantity")
    status = (
        F.when(~c("reorder_required"), "NO ORDER REQUIRED")
        .when(final <= 0, "BLOCKED BY CONSTRAINTS")
        .when(final < raw, "PARTIALLY CONSTRAINED")
        .otherwise("ORDER RECOMMENDED")
    )
    return rows.withColumns({
        "final_order_value": final * cost,
        "unmet_requirement_quantity": F.greatest(raw - final, F.lit(0.0)),
        "capital_constrained": c("affordable_quantity") < wanted,
        "capacity_constrained": c("capacity_feasible_quantity") < wanted,
        "shelf_life_constrained": c("shelf_life_max_quantity") < wanted,
        "recommendation_status": status,
    })


_NORMALISED = {
    "coverage": "coverage_gap_days",
    "stockout": "stockout_cost_per_unit",
    "demand": "expected_daily_demand",
    "unmet": "unmet_requirement_quantity",
    "priority": "priority_weight",
}


def urgency_band(score: Column) -> Column:
    band = F.when(score >= BANDS[0][0], BANDS[0][1])
    for floor, label in BANDS[1:]:
        band = band.when(score >= floor, label)
    return band.otherwise(LOWEST_BAND)


def with_maxima(recommended: DataFrame) -> DataFrame:
    """The five normalising maxima over all reorders, from one one-row aggregate."""
    reorder = F.col("reorder_required")
    return with_grand_total(
        recommended, {f"max_{n}": F.max(F.when(reorder, F.col(c))) for n, c in _NORMALISED.items()}
    )


def with_urgency(recommended: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Urgency of every reorder: six normalised components, weighted, times 100.

    Rows that need no reorder keep a NULL score and band. ``recommended``
    should be a written table: it is read for the maxima and for the rows.
    """
    if abs(sum(weights.values()) - 1) > 1e-9 or min(weights.values()) < 0:
        raise ValueError("weights must be non-negative and sum to 1")
    scored = with_maxima(recommended)
    reorder = F.col("reorder_required")

    def part(name: str) -> Column:
        if name == "supplier":
            return F.coalesce(F.lit(1.0) - F.col("on_time_delivery_rate"), F.lit(0.0))
        return F.coalesce(F.try_divide(F.col(_NORMALISED[name]), F.col(f"max_{name}")), F.lit(0.0))

    total = None
    for name in ("coverage", "stockout", "demand", "unmet", "supplier", "priority"):
        term = F.lit(float(weights[name])) * part(name)
        total = term if total is None else total + term
    scored = scored.withColumn("urgency_score", F.when(reorder, total * 100.0))
    return scored.withColumn("urgency_band", F.when(reorder, urgency_band(F.col("urgency_score")))).drop(
        *[f"max_{n}" for n in _NORMALISED]
    )


def priority_scored_order(recommended: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """The scored reorders."""
    return with_urgency(recommended, weights).filter("reorder_required")

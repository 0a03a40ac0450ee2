"""Status and action per decision, publication gates, BI views, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators import gates
from shelfwise.plans import decisions
from shelfwise.schemas import DECISION_KEY, SERIES_KEY
from shelfwise.sources import versions

CONTROL_TOWER = [
    *DECISION_KEY, "expected_daily_demand", "demand_std", "on_hand_quantity", "on_order_quantity",
    "backorder_quantity", "inventory_position", "days_of_supply", "average_lead_time_days",
    "coverage_gap_days", "safety_stock", "reorder_point", "reorder_required", "raw_order_quantity",
    "final_recommended_quantity", "capital_constrained", "capacity_constrained", "shelf_life_constrained",
    "urgency_score", "urgency_band", "stockout_cost_per_unit", "on_time_delivery_rate", "priority_weight",
    "allocated_quantity", "allocated_order_value", "funding_status", "control_tower_status",
    "recommended_action",
]
WATCH_MARGIN_DAYS = 3

# Action text per status.
ACTIONS = {
    "CRITICAL - ORDER NOW": "Place replenishment order immediately",
    "HIGH - ORDER NOW": "Place replenishment order",
    "CRITICAL - FUNDING ESCALATION": "Escalate working-capital request",
    "REORDER - UNFUNDED": "Hold in funding queue and review priority",
    "REORDER - FUNDED": "Proceed with funded replenishment",
    "WATCH": "Monitor inventory coverage closely",
    "HEALTHY": "No immediate replenishment action",
}
URGENT_CONSTRAINT_ACTION = "Urgent: resolve procurement/physical constraints; reassess funding"
CONSTRAINT_ACTION = "Review MOQ, capacity, capital or shelf-life constraint"


def enrich(recommended: DataFrame, scored: DataFrame, allocation: DataFrame) -> DataFrame:
    """Optional score and allocation per decision, for scores kept in their own table."""
    score = scored.select(*DECISION_KEY, "urgency_score", "urgency_band")
    return with_allocation(recommended.join(score, DECISION_KEY, "left"), allocation)


def with_allocation(decided: DataFrame, allocation: DataFrame) -> DataFrame:
    """Optional allocation per decision, missing amounts as 0."""
    funds = allocation.select(
        *DECISION_KEY, "allocated_quantity", "allocated_order_value",
        F.col("funding_status").alias("_funding"),
    )
    rows = decided.join(funds, DECISION_KEY, "left")
    funding = (
        F.when(~F.col("reorder_required"), "NOT REQUIRED")
        .when(F.col("_funding").isNotNull(), F.col("_funding"))
        .when(F.col("final_recommended_quantity") <= 0, "BLOCKED")
        .otherwise("UNFUNDED")
    )
    return rows.withColumns({
        "allocated_quantity": F.coalesce("allocated_quantity", F.lit(0.0)),
        "allocated_order_value": F.coalesce("allocated_order_value", F.lit(0.0)),
        "funding_status": funding,
    }).drop("_funding")


def status_column() -> Column:
    c = F.col
    reorder, band, funded = c("reorder_required"), c("urgency_band"), c("allocated_quantity") > 0
    return (
        F.when(reorder & (c("final_recommended_quantity") <= 0), "CONSTRAINED - ESCALATE")
        .when(reorder & (band == "CRITICAL") & funded, "CRITICAL - ORDER NOW")
        .when(reorder & (band == "HIGH") & funded, "HIGH - ORDER NOW")
        .when(reorder & band.isin("CRITICAL", "HIGH") & ~funded, "CRITICAL - FUNDING ESCALATION")
        .when(reorder & ~funded, "REORDER - UNFUNDED")
        .when(reorder & funded, "REORDER - FUNDED")
        .when(c("days_of_supply") <= c("average_lead_time_days") + WATCH_MARGIN_DAYS, "WATCH")
        .otherwise("HEALTHY")
    )


def action_column(status: Column | None = None) -> Column:
    status = F.col("control_tower_status") if status is None else status
    stuck = status == "CONSTRAINED - ESCALATE"
    action = F.when(stuck & F.col("urgency_band").isin("CRITICAL", "HIGH"), URGENT_CONSTRAINT_ACTION)
    action = action.when(stuck, CONSTRAINT_ACTION)
    for name, text in ACTIONS.items():
        action = action.when(status == name, text)
    return action


def control_tower(decided: DataFrame, allocation: DataFrame) -> DataFrame:
    """Mart rows from scored decisions: the allocation is the only join."""
    rows = with_allocation(decided, allocation).withColumn("control_tower_status", status_column())
    return rows.withColumn("recommended_action", action_column())


def reclassify(tower: DataFrame) -> DataFrame:
    """Recompute status and action of a published mart (feasibility first)."""
    rows = tower.withColumn("control_tower_status", status_column())
    return rows.withColumn("recommended_action", action_column())


def correct_classification(spark: SparkSession, base: str, table: str, schema: StructType) -> versions.Snapshot:
    """Correct status and action of a published mart where they are wrong; amounts and right rows stay untouched."""
    status = status_column()
    action = action_column(status)
    wrong = ~F.col("control_tower_status").eqNullSafe(status) | ~F.col("recommended_action").eqNullSafe(action)
    return versions.update(spark, base, table, schema, wrong, {"control_tower_status": status, "recommended_action": action})


def lineage_gate(tower: DataFrame, forecast: DataFrame) -> DataFrame:
    """Decisions whose demand is the floored prediction of their own forecast row, made by the model they name."""
    f = forecast.select(
        *SERIES_KEY, F.col("run_id").alias("forecast_run_id"),
        F.col("target_date").alias("forecast_target_date"), "prediction", F.col("model_id").alias("_model"),
    )
    joined = tower.join(f, [*SERIES_KEY, "forecast_run_id", "forecast_target_date"])
    demand = F.abs(F.col("expected_daily_demand")
                   - F.greatest(F.col("prediction"), F.lit(decisions.DEMAND_FLOOR))) < 1e-8
    same = demand & F.col("model_id").eqNullSafe(F.col("_model"))
    return joined.agg(F.count(F.lit(1)).alias("joined_rows"), F.count_if(same).alias("lineage_rows"))


def tower_gates(tower: DataFrame, sample_size: int, budget: float) -> DataFrame:
    """Publication checks; ``tower`` carries MOQ, pack and supplier cost."""
    c = F.col
    given, value = c("allocated_quantity"), c("allocated_order_value")
    packs = given / c("case_pack_size")
    rules = {
        "allocation_nonnegative": (given >= 0) & (value >= 0),
        "allocation_within_feasible": given <= c("final_recommended_quantity") + 1e-8,
        "allocation_reaches_moq": (given == 0) | (given + 1e-8 >= c("minimum_order_quantity")),
        "allocation_whole_packs": (given == 0) | (F.abs(packs - F.floor(packs + 0.5)) <= 1e-8),
        "infeasible_is_constrained": ~c("reorder_required") | (c("final_recommended_quantity") > 0)
        | (c("control_tower_status") == "CONSTRAINED - ESCALATE"),
        "value_matches_quantity": F.abs(value - given * c("supplier_unit_cost")) <= 1e-6,
    }
    spent = tower.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("v"))
    over = spent.select(
        ((F.col("v") > budget + 1e-6) | (F.col("v") < 0)).cast("bigint").alias("budget_exceeded")
    )
    return gates.all_of([
        gates.row_count_gate(tower, "decision_rows", sample_size),
        gates.unpivot_counts(over),
        gates.rule_violations(tower, rules),
    ])


def bi_demand_history(fact: DataFrame, tower: DataFrame) -> DataFrame:
    """Observed sales of published series up to their decision date."""
    keys = tower.select(*SERIES_KEY, "decision_date")
    return (
        fact.join(keys, SERIES_KEY).filter(F.col("dt") <= F.col("decision_date"))
        .select(*SERIES_KEY, "dt", "sale_amount", "stockout_hours")
    )


def bi_forecast_outlook(tower: DataFrame, forecast: DataFrame, run: DataFrame) -> DataFrame:
    """Published decision next to its forecast and run; ``run`` is ``tables.run_table``, ``tower`` of one run.

    ``generated_at`` is the time at which the run ended. An unknown run leaves it and the budget null.
    """
    f = forecast.select(
        *SERIES_KEY, "as_of_date", F.col("target_date").alias("forecast_date"),
        F.col("prediction").alias("predicted_demand"), F.col("run_id").alias("forecast_run_id"),
        "input_policy",
    )
    # A snapshot belongs to one run; its configuration is one row, so no row of the mart moves for it.
    current = tower.agg(F.max("forecast_run_id").alias("_run"))
    budget = F.get_json_object("config", "$.budget").cast("double")
    r = run.join(F.broadcast(current), F.col("run_id") == F.col("_run")).agg(
        F.max(budget).alias("scenario_budget"), F.max("finished_at").alias("generated_at"))
    return tower.join(f, [*SERIES_KEY, "forecast_run_id"]).filter(
        F.col("forecast_date") == F.col("forecast_target_date")
    ).crossJoin(F.broadcast(r)).select(
        *SERIES_KEY, "as_of_date", "forecast_date", "predicted_demand", "model_id", "forecast_run_id",
        "generated_at", "input_policy", *[x for x in CONTROL_TOWER[5:] if x not in (
            "reorder_required", "stockout_cost_per_unit", "on_time_delivery_rate", "priority_weight")],
        "minimum_order_quantity", "case_pack_size", "scenario_budget",
    )


def outlook_gates(outlook: DataFrame, tower: DataFrame) -> DataFrame:
    """Every published series stands in the outlook once, with a demand for the next day and a finished run."""
    c = F.col
    rules = {
        "forecast_not_next_day": c("forecast_date").eqNullSafe(F.date_add("as_of_date", 1)),
        "demand_missing": c("predicted_demand").isNotNull(),
        "run_not_finished": c("generated_at").isNotNull(),
    }
    return gates.all_of([
        gates.row_count_gate(outlook, "outlook_rows", tower.count()),
        gates.unique_key_gate(outlook, SERIES_KEY, "repeated_series"),
        gates.rule_violations(outlook, rules),
    ])


def mart_totals(tower: DataFrame) -> DataFrame:
    c = F.col
    return tower.agg(
        F.count(F.lit(1)).alias("series"),
        F.sum("allocated_order_value").alias("allocated_capital"),
        F.sum("allocated_quantity").alias("funded_quantity"),
        F.count_if(c("allocated_quantity") > 0).alias("funded_orders"),
        F.count_if(c("capital_constrained")).alias("capital_constrained"),
        F.count_if(c("capacity_constrained")).alias("capacity_constrained"),
        F.count_if(c("shelf_life_constrained")).alias("shelf_life_constrained"),
    )


def status_counts(tower: DataFrame) -> DataFrame:
    return tower.groupBy("control_tower_status").agg(F.count(F.lit(1)).alias("series"))


def reconciliation(tower: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Recompute every decision number from its published inputs and count misses."""
    c = F.col
    mu, lead = c("expected_daily_demand"), c("average_lead_time_days")
    safety = decisions.safety_stock(
        mu, c("demand_std"), lead, c("lead_time_std_days"), c("target_service_level"))
    position = c("on_hand_quantity") + c("on_order_quantity") - c("backorder_quantity")
    packs = c("allocated_quantity") / c("case_pack_size")
    redone = {
        "inventory_position": position,
        "safety_stock": safety,
        "reorder_point": mu * lead + safety,
        "days_of_supply": c("on_hand_quantity") / mu,
        "coverage_gap_days": F.greatest(lead - c("on_hand_quantity") / mu, F.lit(0.0)),
        "raw_order_quantity": F.greatest(mu * c("planning_horizon_days") + safety - position, F.lit(0.0)),
    }
    rules = {n: F.abs(c(n) - v) <= tolerance for n, v in redone.items()}
    rules["expected_demand"] = F.abs(mu - F.greatest(c("prediction"), F.lit(decisions.DEMAND_FLOOR))) <= tolerance
    rules["funded_reaches_moq"] = (c("allocated_quantity") == 0) | (
        (c("allocated_quantity") >= c("minimum_order_quantity"))
        & (c("allocated_quantity") <= c("final_recommended_quantity")))
    rules["funded_whole_packs"] = F.abs(packs - F.floor(packs + 0.5)) < 1e-8
    return gates.rule_violations(tower, rules)

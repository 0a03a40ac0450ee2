"""Deterministic synthetic inventory, supplier and priority inputs per series.

Every draw is a hash of (seed, salt, store, product): repeatable, independent
of partitioning, and computed in the row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import (
    coefficient_of_variation,
    four_digits,
    hash_order_numbers,
    hash_uniform,
    money,
    round_half_up,
    share,
)
from shelfwise.operators import gates
from shelfwise.operators.ordered import first_rows
from shelfwise.schemas import SERIES_KEY

PACKS = [1, 6, 12, 24]  # fixed values
MEAN_FLOOR = 0.05


def series_profiles(train_rows: DataFrame) -> DataFrame:
    """Demand statistics per series, rounded so later thresholds are stable."""
    y = F.col("sale_amount")
    stats = train_rows.groupBy(*SERIES_KEY).agg(
        round_half_up(F.avg(y), 6).alias("mean_daily_demand"),
        round_half_up(F.stddev_samp(y), 6).alias("demand_std"),
        F.max(y).alias("max_daily_demand"),
        round_half_up(F.avg("stockout_hours"), 6).alias("avg_stockout_hours"),
        round_half_up(share(y == 0), 6).alias("zero_sales_fraction"),
    )
    cv = coefficient_of_variation(F.col("mean_daily_demand"), F.col("demand_std"))
    return stats.withColumn("cv", round_half_up(cv, 6))


def sample_series(profiles: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` series: a quarter by volume, a quarter of the rest by
    variability, the remainder by hash order.

    Every stratum is a condition on the row, found by counting values, so
    ``profiles``, a written table, is neither sorted nor moved.
    """
    key = [(F.col(k), False) for k in SERIES_KEY]
    quarter = size // 4
    volume = first_rows(profiles, [(F.col("mean_daily_demand"), True), *key], quarter)
    rest = profiles.filter(~volume)
    cv = [(F.col("cv").isNull().cast("int"), False), (F.coalesce("cv", F.lit(0.0)), True)]
    variability = first_rows(rest, [*cv, *key], quarter)
    draws = [(c, False) for c in hash_order_numbers("sample", *[c for c, _ in key], seed=seed)]
    drawn = first_rows(rest.filter(~variability), [*draws, *key], size - 2 * quarter)
    stratum = F.when(volume, "high_volume").when(variability, "high_variability").when(drawn, "sampled")
    return profiles.withColumn("stratum", stratum).filter("stratum IS NOT NULL")


def not_selected(profiles: DataFrame, selected: DataFrame) -> DataFrame:
    return profiles.join(selected.select(*SERIES_KEY), SERIES_KEY, "left_anti")


def service_level(mean: Column, cv: Column) -> Column:
    return F.when(mean >= 2, 0.99).when((cv >= 1.5) | (mean >= 1), 0.975).otherwise(0.95)


def _u(salt: str, seed: int) -> Column:
    return hash_uniform(salt, *[F.col(k) for k in SERIES_KEY], seed=seed)


def floored_mean() -> Column:
    return F.greatest(F.col("mean_daily_demand"), F.lit(MEAN_FLOOR))


def inventory_position(selected: DataFrame, as_of: str, seed: int = 42) -> DataFrame:
    md, u = floored_mean(), lambda s: _u(s, seed)
    on_order = F.when(u("oo?") < 0.55, money(md * (F.lit(2.0) + u("oo") * 8.0))).otherwise(0.0)
    as_of_date = F.lit(date.fromisoformat(as_of)).cast("date")
    receipt = F.date_add(as_of_date, (F.floor(u("rc") * 13.0) + 2).cast("int"))
    return selected.select(
        *SERIES_KEY,
        as_of_date.alias("as_of_date"),
        money(md * (F.lit(4.0) + u("doh") * 14.0)).alias("on_hand_quantity"),
        on_order.alias("on_order_quantity"),
        F.when(u("bo?") < 0.15, money(md * (F.lit(0.5) + u("bo") * 2.5))).otherwise(0.0)
        .alias("backorder_quantity"),
        F.when(on_order > 0, receipt).alias("expected_next_receipt_date"),
        money(F.lit(5.0) + u("uc") * 145.0).alias("unit_cost"),
        money(md * (F.lit(10.0) + u("cap") * 30.0)).alias("warehouse_capacity_remaining"),
    )


def supplier_policy(selected: DataFrame, seed: int = 42) -> DataFrame:
    md, u = floored_mean(), lambda s: _u(s, seed)
    packs = F.array(*[F.lit(float(p)) for p in PACKS])
    return selected.select(
        *SERIES_KEY,
        (F.col("product_id") % 25 + 1).alias("supplier_id"),
        money(F.lit(5.0) + u("lt") * 9.0).alias("average_lead_time_days"),
        money(F.lit(0.5) + u("ls") * 2.5).alias("lead_time_std_days"),
        money(F.greatest(F.lit(1.0), md * (F.lit(3.0) + u("moq") * 7.0))).alias("minimum_order_quantity"),
        F.get(packs, F.floor(u("pack") * 4.0).cast("int")).alias("case_pack_size"),
        service_level(md, F.col("cv")).alias("target_service_level"),
        F.when(u("hor") < 0.5, 21).otherwise(28).alias("planning_horizon_days"),
        money(F.lit(5.0) + u("cost") * 135.0).alias("supplier_unit_cost"),
        four_digits(F.lit(0.8) + u("otd") * 0.19).alias("on_time_delivery_rate"),
        F.lit(True).alias("active_flag"),
    )


def product_priority(selected: DataFrame, seed: int = 42) -> DataFrame:
    md, u = floored_mean(), lambda s: _u(s, seed)
    shelf = F.when(u("sh?") < 0.30, (F.floor(u("sh") * 166.0) + 14).cast("int"))
    weight = (
        F.lit(1.0)
        + F.least(md / 5.0, F.lit(1.5))
        + F.least(F.coalesce(F.col("cv"), F.lit(0.0)) / 3.0, F.lit(1.0))
    )
    return selected.select(
        *SERIES_KEY,
        money(F.lit(10.0) + u("so") * 240.0).alias("stockout_cost_per_unit"),
        four_digits(F.lit(0.01) + u("hc") * 1.49).alias("holding_cost_per_unit_day"),
        shelf.alias("shelf_life_days"),
        money(md * (F.lit(100.0) + u("wc") * 500.0)).alias("working_capital_limit"),
        four_digits(weight).alias("priority_weight"),
    )


def _null_or(c: str, cond: Column) -> Column:
    return F.col(c).isNull() | cond


def inventory_rules() -> dict[str, Column]:
    names = ["on_hand_quantity", "on_order_quantity", "backorder_quantity", "unit_cost",
             "warehouse_capacity_remaining"]
    return {f"{c}_nonnegative": _null_or(c, F.col(c) >= 0) for c in names}


def supplier_rules() -> dict[str, Column]:
    c = F.col
    return {
        "lead_time_positive": c("average_lead_time_days") > 0,
        "lead_time_std_nonnegative": c("lead_time_std_days") >= 0,
        "moq_nonnegative": c("minimum_order_quantity") >= 0,
        "pack_positive": c("case_pack_size") > 0,
        "service_level_open_unit": (c("target_service_level") > 0) & (c("target_service_level") < 1),
        "horizon_positive": c("planning_horizon_days") > 0,
        "supplier_cost_nonnegative": _null_or("supplier_unit_cost", c("supplier_unit_cost") >= 0),
        "on_time_rate_unit": _null_or("on_time_delivery_rate", c("on_time_delivery_rate").between(0, 1)),
    }


def priority_rules() -> dict[str, Column]:
    c = F.col
    return {
        "stockout_cost_nonnegative": _null_or("stockout_cost_per_unit", c("stockout_cost_per_unit") >= 0),
        "holding_cost_nonnegative": _null_or("holding_cost_per_unit_day", c("holding_cost_per_unit_day") >= 0),
        "shelf_life_positive": _null_or("shelf_life_days", c("shelf_life_days") > 0),
        "capital_nonnegative": _null_or("working_capital_limit", c("working_capital_limit") >= 0),
        "weight_positive": c("priority_weight") > 0,
    }


def scenario_gates(inventory: DataFrame, supplier: DataFrame, priority: DataFrame) -> DataFrame:
    return gates.all_of([
        gates.rule_violations(inventory, inventory_rules()),
        gates.rule_violations(supplier, supplier_rules()),
        gates.rule_violations(priority, priority_rules()),
    ])


def scenario_action(inventory: DataFrame, size: int, as_of: str, regenerate: bool = False) -> DataFrame:
    """``generate``, ``reuse`` or ``refuse`` for an existing scenario table.

    An existing scenario of another size or date is never silently replaced.
    """
    day = F.lit(as_of).cast("date")
    n, low, high = F.col("series"), F.col("first_date"), F.col("last_date")
    action = (
        F.when((n == 0) | F.lit(regenerate), "generate")
        .when((n == size) & (low == day) & (high == day), "reuse")
        .otherwise("refuse")
    )
    return inventory.agg(
        F.count(F.lit(1)).alias("series"), F.min("as_of_date").alias("first_date"),
        F.max("as_of_date").alias("last_date"),
    ).withColumn("action", action)

"""Raw rows to typed staging, dimensions, bridge, fact and hourly view."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.scalars import iso_weekday
from shelfwise.operators import gates
from shelfwise.schemas import (
    BRIDGE_STORE_GROUP,
    DAILY_KEY,
    DIM_DATE,
    DIM_PRODUCT,
    DIM_STORE,
    FACT_DAILY_DEMAND,
    STAGING_RETAIL_DAILY,
)
from shelfwise.sources import versions

MIXED_GROUPS = -1  # fixed value: a store served by several management groups


def staging(raw: DataFrame) -> DataFrame:
    """Typed daily rows. A malformed date raises (ANSI cast)."""
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in STAGING_RETAIL_DAILY])


def hourly(raw: DataFrame) -> DataFrame:
    """One row per hour: the two 24-element arrays side by side."""
    pairs = F.arrays_zip("hours_sale", "hours_stock_status")
    return raw.select(
        "store_id", "product_id", F.col("dt").cast("date").alias("dt"), "source_file",
        F.posexplode(pairs).alias("hour_of_day", "h"),
    ).select(
        "store_id", "product_id", "dt", "hour_of_day",
        F.col("h.hours_sale").alias("sale_amount"),
        F.col("h.hours_stock_status").alias("stock_status"),
        "source_file",
    )


def dim_product(stage: DataFrame) -> DataFrame:
    return stage.select(
        "product_id", "first_category_id", "second_category_id", "third_category_id"
    ).distinct()


def dim_store(stage: DataFrame) -> DataFrame:
    """One row per store; MIN = MAX says the store has a single group."""
    group = F.col("management_group_id")
    return stage.groupBy("store_id").agg(
        F.min("city_id").alias("city_id"),
        F.when(F.min(group) == F.max(group), F.min(group))
        .otherwise(F.lit(MIXED_GROUPS).cast("bigint")).alias("management_group_id"),
    )


def calendar(dt_frame: DataFrame) -> DataFrame:
    """Calendar attributes of the distinct ``dt`` values."""
    dt = F.col("dt")
    return dt_frame.select("dt").distinct().select(
        "dt",
        F.year(dt).alias("year"),
        F.month(dt).alias("month"),
        F.day(dt).alias("day"),
        iso_weekday(dt).alias("day_of_week"),
        F.date_format(dt, "EEEE").alias("day_name"),
        F.weekofyear(dt).alias("week_of_year"),
        (iso_weekday(dt) >= 6).alias("is_weekend"),
    )


def dim_date(stage: DataFrame) -> DataFrame:
    return calendar(stage)


def bridge_store_group(stage: DataFrame) -> DataFrame:
    return stage.select("store_id", "management_group_id").distinct()


def fact(stage: DataFrame) -> DataFrame:
    renamed = stage.withColumnRenamed("stock_hour6_22_cnt", "stockout_hours")
    return renamed.select(*[F.col(f.name).cast(f.dataType) for f in FACT_DAILY_DEMAND])


def star_join(fact_rows: DataFrame, products: DataFrame, dates: DataFrame) -> DataFrame:
    """Fact with product and calendar attributes (inner joins).

    No forced broadcast: pass written dimension tables and the planner
    broadcasts them when their file size is under the session's threshold,
    and sort-merges (with AQE skew splitting) otherwise.
    """
    return fact_rows.join(products, "product_id").join(dates, "dt")


def staging_rules() -> dict:
    c = F.col
    return {
        "stock_hours_0_16": c("stock_hour6_22_cnt").between(0, 16),
        "sale_nonnegative": c("sale_amount") >= 0,
        "holiday_flag_binary": c("holiday_flag").isin(0, 1),
        "activity_flag_binary": c("activity_flag").isin(0, 1),
        "sale_finite": ~F.isnan("sale_amount") & (F.abs("sale_amount") != F.lit(float("inf"))),
    }


# Layer tables and the names of their row counts in the gates.
LAYERS = {"staging": "staging_rows", "fact": "fact_rows", "dim_product": "product_rows", "dim_store": "store_rows", "dim_date": "date_rows"}


def watched() -> dict[str, dict[str, Column]]:
    """What is counted while each layer is written: its rows; nulls and broken rules of staging."""
    names = [f.name for f in STAGING_RETAIL_DAILY]
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in names])
    rules = {n: F.count_if(~F.coalesce(c, F.lit(True))) for n, c in staging_rules().items()}
    counts = {layer: {name: F.count(F.lit(1))} for layer, name in LAYERS.items()}
    return counts | {"staging": counts["staging"] | {"null_values": nulls, **rules}}


def stored_gates(stored: Mapping[str, DataFrame], seen: Mapping[str, Mapping[str, int]], expected: Mapping[str, int]) -> DataFrame:
    """All checks of a written warehouse as one table (check, actual, expected, ok).

    Counts come from the writes, keys and orphans from the stored layers.
    ``expected`` (rows, products, stores, dates) comes from the source, not from
    the layers that it is compared with.
    """
    rows, stage = stored["fact"], stored["staging"]
    sizes = {"staging_rows": "rows", "fact_rows": "rows", "product_rows": "products", "store_rows": "stores", "date_rows": "dates"}
    counts = {n: v for layer in LAYERS for n, v in seen[layer].items()}
    return gates.all_of([
        gates.counted(rows.sparkSession, counts, {n: expected[k] for n, k in sizes.items()}),
        gates.unique_key_gate(rows, DAILY_KEY, "duplicate_business_keys"),
        gates.foreign_key_gate(rows, stored["dim_product"], ["product_id"], "orphan_products"),
        gates.foreign_key_gate(rows, stored["dim_store"], ["store_id"], "orphan_stores"),
        gates.foreign_key_gate(rows, stored["dim_date"], ["dt"], "orphan_dates"),
        gates.single_value_gate(stage, "store_id", "city_id", "stores_with_two_cities"),
    ])


Stored = Mapping[str, DataFrame]
LAYER_SCHEMAS = {
    "staging": STAGING_RETAIL_DAILY, "dim_product": DIM_PRODUCT, "dim_store": DIM_STORE, "dim_date": DIM_DATE,
    "bridge_store_group": BRIDGE_STORE_GROUP, "fact": FACT_DAILY_DEMAND,
}


def build(
    spark: SparkSession, base: str, stage: DataFrame, expected: Mapping[str, int],
    more: Mapping[str, Callable[[Stored], DataFrame]] | None = None,
    more_checks: Callable[[Stored], DataFrame] | None = None,
) -> versions.Snapshot:
    """All derived layers of ``stage`` in one version: none of them changes unless every gate holds.

    ``more`` are further layers made from the stored ones, with ``more_checks`` of their own.
    """
    layers = {
        "staging": stage,
        "dim_product": lambda t: dim_product(t["staging"]),
        "dim_store": lambda t: dim_store(t["staging"]),
        "dim_date": lambda t: dim_date(t["staging"]),
        "bridge_store_group": lambda t: bridge_store_group(t["staging"]),
        "fact": lambda t: fact(t["staging"]),
        **(more or {}),
    }

    def checks(stored: Stored, seen: Mapping[str, Mapping[str, int]]) -> DataFrame:
        own = stored_gates(stored, seen, expected)
        return own.unionByName(more_checks(stored)) if more_checks else own

    return versions.replace(spark, base, layers, checks, watched())

"""Spending one shared budget over globally ranked orders, exactly.

Taking the orders strictly in rank would be one step per order. Instead each
round funds whole range partitions at once: sums of the order values per
partition show how many partitions the budget covers in full. The first one it
does not cover is walked in rank by one executor task, and the next round goes
on behind it, so there are at most as many rounds as partitions. Orders that
not even their smallest purchase fits are out for good, because the budget only
shrinks. The driver sees one sum per partition. Quantities are whole packs and
money is decimal, so sums are exact for any pack size and unit cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ordered import PART, POS, globally_sorted, with_rank, with_running_total
from shelfwise.schemas import DECISION_KEY
from shelfwise.sources.storage import new_path

MONEY = "decimal(38,8)"
_UNITS = 10**8

PROCUREMENT_ALLOCATION = [
    "priority_rank", *DECISION_KEY, "urgency_score", "urgency_band", "minimum_order_quantity",
    "case_pack_size", "supplier_unit_cost", "requested_quantity", "requested_order_value",
    "allocated_quantity", "allocated_order_value", "unmet_quantity_after_allocation", "funding_status",
    "budget_before_order", "budget_after_order",
]


def rank_order() -> list[Column]:
    return [F.desc("urgency_score"), F.col("store_id"), F.col("product_id")]


def to_money(c: Column) -> Column:
    return c.cast("decimal(28,8)")


def budget_amount(budget: float) -> Decimal:
    if not math.isfinite(budget) or budget < 0:
        raise ValueError("budget must be finite and not negative")
    return Decimal(repr(float(budget))).quantize(Decimal("1e-8"), rounding="ROUND_DOWN")


def eligible_orders(scored: DataFrame) -> DataFrame:
    """Reorders with a positive, costed quantity that reaches the supplier's MOQ."""
    q, cost = F.col("final_recommended_quantity"), F.col("supplier_unit_cost")
    return scored.filter(
        F.col("reorder_required") & (q > 0) & (cost > 0) & (q >= F.col("minimum_order_quantity"))
    ).select(
        *DECISION_KEY, "urgency_score", "urgency_band", "minimum_order_quantity", "case_pack_size",
        "supplier_unit_cost", q.alias("requested_quantity"), (q * cost).alias("requested_order_value"),
    )


def ranked_orders(scored: DataFrame) -> DataFrame:
    """Eligible orders with their global priority rank, placed in that order."""
    return with_rank(globally_sorted(eligible_orders(scored), rank_order(), "orders"), "priority_rank")


def funding_status(given: Column, wanted: Column) -> Column:
    return F.when(given == 0, "UNFUNDED").when(given < wanted, "PARTIALLY FUNDED").otherwise("FULLY FUNDED")


def _walk(left: int):
    """Orders of one partition in rank, from a budget of ``left`` units: rank and packs given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = left
        for rows in batches:
            given = []
            for price, packs, pack, moq in zip(rows["_price"], rows["_packs"], rows["case_pack_size"], rows["minimum_order_quantity"]):
                units = int(price * _UNITS)
                n = min(packs, rest // units) if units else packs
                n = n if n > 0 and n * pack >= moq else 0
                rest -= n * units
                given.append(n)
            yield pd.DataFrame({"priority_rank": rows["priority_rank"], "_walked": pd.Series(given, dtype="int64")})

    return run


def _plan_rounds(orders: DataFrame, left: Decimal) -> tuple[list[tuple[int, Decimal]], str | None]:
    """Partitions funded in full with the budget that decides who is open there, and the folder of the walked ones."""
    covered: list[tuple[int, Decimal]] = []
    folder, after = None, -1
    while True:
        open_orders = orders.filter((F.col(PART) > after) & (F.col("_least") <= F.lit(left)))
        sums = sorted((r[PART], r["s"]) for r in open_orders.groupBy(PART).agg(F.sum("_full").cast(MONEY).alias("s")).collect())
        spent, pivot = Decimal(0), None
        for part, s in sums:
            if spent + s > left:
                pivot = part
                break
            spent += s
            covered.append((part, left))
        left -= spent
        if pivot is None:
            return covered, folder
        folder = folder or new_path(orders.sparkSession, "walked")
        path = f"{folder}/part={pivot}"
        own = orders.filter(F.col(PART) == pivot).repartition(1).sortWithinPartitions(POS).select(
            "priority_rank", "_price", "_packs", "case_pack_size", "minimum_order_quantity")
        own.mapInPandas(_walk(int(left * _UNITS)), "priority_rank long, _walked long").write.parquet(path)
        walked = orders.sparkSession.read.parquet(path).join(orders.filter(F.col(PART) == pivot), "priority_rank")
        left -= walked.agg(F.sum(_cost("_walked")).cast(MONEY).alias("s")).first()["s"]
        after = pivot


def _cost(packs: str) -> Column:
    return (F.col(packs).cast("decimal(10,0)") * F.col("_price")).cast(MONEY)


def procurement_allocation(scored: DataFrame, budget: float) -> DataFrame:
    """Whole-pack greedy allocation in rank order with MOQ, one row per eligible order."""
    return allocate_ranked(ranked_orders(scored), budget)


def allocate_ranked(ranked: DataFrame, budget: float) -> DataFrame:
    spark = ranked.sparkSession
    pack, moq = F.col("case_pack_size"), F.col("minimum_order_quantity")
    price = F.col("case_pack_size").cast("decimal(18,6)") * F.col("supplier_unit_cost").cast("decimal(18,8)")
    # A quotient a few ulp off a whole number of packs is that number.
    orders = ranked.withColumns({
        "_price": price.cast("decimal(22,8)"),
        "_packs": F.floor(F.col("requested_quantity") / pack + 1e-9).cast("bigint"),
        "_least_packs": F.greatest(F.ceil(moq / pack - 1e-9).cast("bigint"), F.lit(1).cast("bigint")),
    }).withColumns({"_full": _cost("_packs"), "_least": _cost("_least_packs")})
    start = budget_amount(budget)
    covered, folder = _plan_rounds(orders, start)
    runs = spark.createDataFrame(covered, f"{PART} int, _budget {MONEY}")
    # One row per partition.
    given = orders.join(F.broadcast(runs), PART, "left")
    packs = F.when(F.col("_least") <= F.col("_budget"), F.col("_packs"))
    if folder:
        walked = spark.read.parquet(folder).select("priority_rank", "_walked")
        given = given.join(walked, "priority_rank", "left")
        packs = F.coalesce("_walked", packs)
    given = given.withColumn("_q", F.coalesce(packs, F.lit(0).cast("bigint"))).withColumn("_spent", _cost("_q"))
    given = with_running_total(given, F.col("_spent"), "_upto", MONEY)
    amount = lambda c: c.cast("double")
    out = given.withColumns({
        "allocated_quantity": F.col("_q") * pack,
        "allocated_order_value": amount(F.col("_spent")),
        "unmet_quantity_after_allocation": (F.col("_packs") - F.col("_q")) * pack,
        "funding_status": funding_status(F.col("_q"), F.col("_packs")),
        "budget_before_order": amount(F.lit(start) - F.col("_upto") + F.col("_spent")),
        "budget_after_order": amount(F.lit(start) - F.col("_upto")),
    })
    return out.select(*PROCUREMENT_ALLOCATION)


def capital_allocation_value(scored: DataFrame, budget: float) -> DataFrame:
    """Prototype rule: cut the running order value at the budget, quantities pro rata."""
    orders = scored.filter("final_recommended_quantity > 0").withColumn(
        "_value", to_money(F.coalesce("final_order_value", F.lit(0.0)))
    )
    placed = globally_sorted(orders, rank_order(), "capital")
    start, none = F.lit(budget_amount(budget)).cast(MONEY), F.lit(0).cast(MONEY)
    run = with_running_total(placed, F.col("_value"), "_upto", MONEY)
    value, upto = F.col("_value").cast(MONEY), F.col("_upto")
    given = F.greatest(none, F.least(value, start - (upto - value)))
    run = run.withColumn("_given", given.cast(MONEY))
    quantity = F.col("final_recommended_quantity")
    return run.select(
        *DECISION_KEY, "urgency_score", "urgency_band",
        quantity.alias("requested_order_quantity"),
        value.cast("double").alias("requested_order_value"),
        F.coalesce(quantity * F.try_divide(F.col("_given").cast("double"), value.cast("double")), F.lit(0.0))
        .alias("allocated_order_quantity"),
        F.col("_given").cast("double").alias("allocated_order_value"),
        funding_status(F.col("_given"), value).alias("funding_status"),
        F.least(upto, start).cast("double").alias("cumulative_budget_used"),
    )

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import gates
from shelfwise.plans import control_tower as ct
from shelfwise.plans import decisions as dn
from shelfwise.plans import kpi

DAY = date(2024, 7, 2)
BASE = dict(
    store_id=1, product_id=1, decision_date=DAY, reorder_required=True, raw_order_quantity=100.0,
    minimum_order_quantity=12.0, case_pack_size=6.0, supplier_unit_cost=2.0, working_capital_limit=100000.0,
    warehouse_capacity_remaining=1000.0, shelf_life_days=None, expected_daily_demand=4.0,
    inventory_position=3.0, priority_weight=1.0,
)
SCHEMA = (
    "store_id long, product_id long, decision_date date, reorder_required boolean, raw_order_quantity double,"
    "minimum_order_quantity double, case_pack_size double, supplier_unit_cost double,"
    "working_capital_limit double, warehouse_capacity_remaining double, shelf_life_days int,"
    "expected_daily_demand double, inventory_position double, priority_weight double"
)


def recommend(spark, **change):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(","))], SCHEMA)
    return dn.order_recommendation(df).first()


@pytest.mark.parametrize("change, final, status", [
    ({}, 102.0, "ORDER RECOMMENDED"),
    ({"warehouse_capacity_remaining": 6.0}, 0.0, "BLOCKED BY CONSTRAINTS"),  # below the MOQ
    ({"warehouse_capacity_remaining": 50.0}, 48.0, "PARTIALLY CONSTRAINED"),
    ({"working_capital_limit": 60.0}, 30.0, "PARTIALLY CONSTRAINED"),
    ({"working_capital_limit": None}, 102.0, "ORDER RECOMMENDED"),
    ({"supplier_unit_cost": None}, 102.0, "ORDER RECOMMENDED"),
    ({"supplier_unit_cost": 0.0, "working_capital_limit": 1.0}, 102.0, "ORDER RECOMMENDED"),
    ({"warehouse_capacity_remaining": None}, 102.0, "ORDER RECOMMENDED"),
    ({"shelf_life_days": 10}, 36.0, "PARTIALLY CONSTRAINED"),
    ({"shelf_life_days": 1, "inventory_position": 50.0}, 0.0, "BLOCKED BY CONSTRAINTS"),
    ({"raw_order_quantity": 3.0}, 12.0, "ORDER RECOMMENDED"),  # lifted to the MOQ
    ({"reorder_required": False}, 0.0, "NO ORDER REQUIRED"),
])
def test_order_caps(spark, change, final, status):
    r = recommend(spark, **change)
    assert (r["final_recommended_quantity"], r["recommendation_status"]) == (final, status)


def test_inventory_math(spark):
    row = spark.createDataFrame(
        [(1, 1, DAY, 10.0, 4.0, 2.0, 0.0, None, 8.0, 2.0, 0.99, 21)],
        "store_id long, product_id long, as_of_date date, on_hand_quantity double, on_order_quantity double,"
        "backorder_quantity double, prediction double, demand_std double, average_lead_time_days double,"
        "lead_time_std_days double, target_service_level double, planning_horizon_days int")
    r = dn.inventory_decision(row).first()
    assert r["expected_daily_demand"] == 0.01 and r["demand_std"] == 0.0 and r["inventory_position"] == 12.0
    assert r["safety_stock"] == pytest.approx(2.326 * 0.02)
    assert r["days_of_supply"] == 1000.0 and r["coverage_gap_days"] == 0.0
    assert not r["reorder_required"] and r["raw_order_quantity"] == 0.0


def test_scores_are_zero_where_a_maximum_is_zero_or_a_value_missing(spark):
    df = spark.createDataFrame(
        [(1, True, 0.0, None, 2.0, 5.0, 1.0, 0.9), (2, True, 0.0, 10.0, 4.0, 10.0, 2.0, None),
         (3, False, 99.0, 99.0, 99.0, 99.0, 99.0, 0.0)],
        "store_id long, reorder_required boolean, coverage_gap_days double, stockout_cost_per_unit double,"
        "expected_daily_demand double, unmet_requirement_quantity double, priority_weight double,"
        "on_time_delivery_rate double")
    got = {r["store_id"]: r for r in dn.priority_scored_order(df).collect()}
    assert set(got) == {1, 2}
    assert got[1]["urgency_score"] == pytest.approx(100 * (0.15 * 0.5 + 0.15 * 0.5 + 0.10 * 0.1 + 0.10 * 0.5))
    assert got[2]["urgency_score"] == pytest.approx(100 * (0.20 + 0.15 + 0.15 + 0.10))
    assert [got[i]["urgency_band"] for i in (1, 2)] == ["LOW", "HIGH"]
    with pytest.raises(ValueError):
        dn.priority_scored_order(df, {**dn.WEIGHTS, "demand": 0.9})


STATUS = [
    # reorder, final, band, allocated, days of supply, status
    (True, 0.0, "CRITICAL", 0.0, 1.0, "CONSTRAINED - ESCALATE", ct.URGENT_CONSTRAINT_ACTION),
    (True, 0.0, "LOW", 0.0, 1.0, "CONSTRAINED - ESCALATE", ct.CONSTRAINT_ACTION),
    (True, 6.0, "CRITICAL", 6.0, 1.0, "CRITICAL - ORDER NOW", None),
    (True, 6.0, "HIGH", 6.0, 1.0, "HIGH - ORDER NOW", None),
    (True, 6.0, "HIGH", 0.0, 1.0, "CRITICAL - FUNDING ESCALATION", None),
    (True, 6.0, "MEDIUM", 0.0, 1.0, "REORDER - UNFUNDED", None),
    (True, 6.0, "LOW", 6.0, 1.0, "REORDER - FUNDED", None),
    (False, 0.0, None, 0.0, 13.0, "WATCH", None),
    (False, 0.0, None, 0.0, 13.5, "HEALTHY", None),
]


def test_every_status_and_action(spark):
    df = spark.createDataFrame(
        [(i, *row[:5], 10.0) for i, row in enumerate(STATUS)],
        "i int, reorder_required boolean, final_recommended_quantity double, urgency_band string,"
        "allocated_quantity double, days_of_supply double, average_lead_time_days double")
    for r in ct.reclassify(df).collect():
        want = STATUS[r["i"]]
        assert r["control_tower_status"] == want[5]
        assert r["recommended_action"] == (want[6] or ct.ACTIONS[want[5]])


def tower_row(spark, **change):
    row = dict(reorder_required=True, final_recommended_quantity=12.0, allocated_quantity=12.0,
               allocated_order_value=24.0, minimum_order_quantity=6.0, case_pack_size=6.0,
               supplier_unit_cost=2.0, control_tower_status="REORDER - FUNDED")
    row.update(change)
    return spark.createDataFrame([row])


def test_publication_gates_find_corruption(spark):
    gates.require(ct.tower_gates(tower_row(spark), 1, 24.0))
    bad = [dict(allocated_quantity=7.0, allocated_order_value=14.0), dict(allocated_order_value=25.0),
           dict(allocated_quantity=18.0, allocated_order_value=36.0), dict(minimum_order_quantity=13.0),
           dict(final_recommended_quantity=0.0, allocated_quantity=0.0, allocated_order_value=0.0)]
    for change in bad:
        with pytest.raises(gates.GateFailure):
            gates.require(ct.tower_gates(tower_row(spark, **change), 1, 1000.0))
    with pytest.raises(gates.GateFailure):
        gates.require(ct.tower_gates(tower_row(spark), 1, 23.0))
    with pytest.raises(gates.GateFailure):
        gates.require(ct.tower_gates(tower_row(spark), 2, 24.0))


def test_ratios_of_an_empty_selection(spark):
    empty = tower_row(spark).filter("false")
    r = kpi.budget_measures(empty, 0.0).first()
    assert (r["reorder_rate"], r["budget_utilisation"], r["funded_reorder_rate"]) == (0.0, 0.0, None)


def test_urgency_label_without_a_score(spark):
    df = spark.createDataFrame([(True, None), (False, "LOW"), (True, "HIGH")],
                               "reorder_required boolean, urgency_band string")
    got = kpi.reorder_urgency(df).select("reorder_urgency", "reorder_urgency_sort").collect()
    assert [tuple(r) for r in got] == [("UNCLASSIFIED", 6), ("NOT REQUIRED", 5), ("HIGH", 2)]
    assert df.select(F.count("*")).first()[0] == 3

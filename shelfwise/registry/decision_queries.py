"""Scenario, decision, allocation and control tower queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import gates, ordered
from shelfwise.plans import allocation as al
from shelfwise.plans import control_tower as ct
from shelfwise.plans import decisions as dn
from shelfwise.plans import scenario as sn
from shelfwise.registry import chain, query
from shelfwise.registry.check_queries import broken, gate_rows
from shelfwise.registry.decision_oracle import TABLES, allocated, walk
from shelfwise.registry.oracle import oracle
from shelfwise.schemas import DECISION_KEY, SERIES_KEY
from shelfwise.sources import tables as t
from shelfwise.sources import versions
from shelfwise.sources.storage import new_path, written

PROFILE_FLOATS = "mean_daily_demand demand_std max_daily_demand avg_stockout_hours zero_sales_fraction cv"

query("series_profiles", oracle("SELECT * FROM profile", PROFILE_FLOATS))(
    lambda s, d: chain.profiles(s, d)[1])

SAMPLE_SQL = oracle("SELECT * FROM selected", PROFILE_FLOATS)
query("scenario_sample", SAMPLE_SQL)(lambda s, d: chain.build_scenario(s, d).selected)
query("stratified_topk_sample", oracle("SELECT stratum, count(*) AS series, sum(mean_daily_demand) AS demand "
                                       "FROM selected GROUP BY stratum", "demand"))(
    lambda s, d: chain.build_scenario(s, d).selected.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("series"), F.sum("mean_daily_demand").alias("demand")))
query("not_in_selected", oracle("""
SELECT p.store_id, p.product_id FROM profile p
WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.store_id = p.store_id AND s.product_id = p.product_id)"""))(
    lambda s, d: (lambda sc: sn.not_selected(sc.profiles, sc.selected))(chain.build_scenario(s, d))
    .select(*SERIES_KEY))
query("dedup_keys", oracle("SELECT DISTINCT product_id, target_service_level FROM supply", "target_service_level"))(
    lambda s, d: chain.build_scenario(s, d).supplier.select("product_id", "target_service_level")
    .dropDuplicates(["product_id", "target_service_level"]))
query("service_level", oracle(
    "SELECT target_service_level, count(*) AS series FROM supply GROUP BY 1", "target_service_level"))(
    lambda s, d: chain.build_scenario(s, d).supplier.groupBy("target_service_level")
    .agg(F.count(F.lit(1)).alias("series")))

query("scenario_inventory", oracle("""
SELECT store_id, product_id, as_of_date, on_hand_quantity, on_order_quantity, backorder_quantity,
       expected_next_receipt_date, unit_cost, warehouse_capacity_remaining FROM inventory""",
    "on_hand_quantity on_order_quantity backorder_quantity unit_cost warehouse_capacity_remaining",
    "as_of_date expected_next_receipt_date"))(lambda s, d: chain.build_scenario(s, d).inventory)
query("scenario_supplier", oracle(
    "SELECT * FROM supply", "average_lead_time_days lead_time_std_days minimum_order_quantity case_pack_size "
    "target_service_level supplier_unit_cost on_time_delivery_rate"))(
    lambda s, d: chain.build_scenario(s, d).supplier)
query("scenario_priority", oracle(
    "SELECT * FROM priority",
    "stockout_cost_per_unit holding_cost_per_unit_day working_capital_limit priority_weight"))(
    lambda s, d: chain.build_scenario(s, d).priority)

_INV = ["on_hand_quantity", "on_order_quantity", "backorder_quantity", "unit_cost", "warehouse_capacity_remaining"]
query("gate_scenario_constraints", oracle(" UNION ALL ".join([
    gate_rows([(f"{c}_nonnegative", broken(f"coalesce({c} >= 0, TRUE)")) for c in _INV], "inventory"),
    gate_rows([
        ("lead_time_positive", broken("average_lead_time_days > 0")),
        ("lead_time_std_nonnegative", broken("lead_time_std_days >= 0")),
        ("moq_nonnegative", broken("minimum_order_quantity >= 0")),
        ("pack_positive", broken("case_pack_size > 0")),
        ("service_level_open_unit", broken("target_service_level > 0 AND target_service_level < 1")),
        ("horizon_positive", broken("planning_horizon_days > 0")),
        ("supplier_cost_nonnegative", broken("coalesce(supplier_unit_cost >= 0, TRUE)")),
        ("on_time_rate_unit", broken("coalesce(on_time_delivery_rate BETWEEN 0 AND 1, TRUE)"))], "supply"),
    gate_rows([
        ("stockout_cost_nonnegative", broken("coalesce(stockout_cost_per_unit >= 0, TRUE)")),
        ("holding_cost_nonnegative", broken("coalesce(holding_cost_per_unit_day >= 0, TRUE)")),
        ("shelf_life_positive", broken("coalesce(shelf_life_days > 0, TRUE)")),
        ("capital_nonnegative", broken("coalesce(working_capital_limit >= 0, TRUE)")),
        ("weight_positive", broken("priority_weight > 0"))], "priority")])))(
    lambda s, d: (lambda sc: sn.scenario_gates(sc.inventory, sc.supplier, sc.priority))(chain.build_scenario(s, d)))

query("scenario_guard", oracle("""
SELECT count(*) AS series, min(as_of_date) AS first_date, max(as_of_date) AS last_date,
       CASE WHEN count(*) = 0 THEN 'generate'
            WHEN count(*) = (SELECT count(*) // 2 FROM profile) AND min(as_of_date) = DATE '2024-07-02'
                 AND max(as_of_date) = DATE '2024-07-02' THEN 'reuse' ELSE 'refuse' END AS action FROM inventory""",
    "", "first_date last_date"))(
    lambda s, d: (lambda sc: sn.scenario_action(sc.inventory, sc.size, chain.AS_OF))(chain.build_scenario(s, d)))

# --- decisions ---------------------------------------------------------------

_FLAGS = {"reorder_required", "capital_constrained", "capacity_constrained", "shelf_life_constrained"}
_TEXT = {"recommendation_status", "urgency_band", "funding_status", "control_tower_status", "recommended_action"}
_WHOLE = {"store_id", "product_id", "supplier_id", "planning_horizon_days", "shelf_life_days", "priority_rank"}


def floats(cols: list[str]) -> str:
    return " ".join(c for c in cols if c not in _FLAGS | _TEXT | _WHOLE | {"decision_date"})


def _listed(name: str, table: str, cols: list[str], build):
    query(name, oracle(f"SELECT {', '.join(cols)} FROM {table}", floats(cols), "decision_date"))(
        lambda s, d: build(chain.build_scenario(s, d)).select(*cols))


_JOINED = ["store_id", "product_id", "decision_date", "on_hand_quantity", "average_lead_time_days",
           "priority_weight", "demand_std", "prediction"]
query("scenario_join", oracle(f"SELECT {', '.join(_JOINED)} FROM decision", floats(_JOINED), "decision_date"))(
    lambda s, d: (lambda sc: dn.scenario_join(sc.inventory, sc.supplier, sc.priority, sc.profiles, sc.forecast))(
        chain.build_scenario(s, d)).withColumnRenamed("as_of_date", "decision_date").select(*_JOINED))
_listed("inventory_decision", "decision", dn.INVENTORY_DECISION, chain.decided)
_listed("order_recommendation", "recommendation", dn.ORDER_RECOMMENDATION,
        lambda sc: dn.order_recommendation(chain.decided(sc)))
_scored = lambda sc: dn.priority_scored_order(chain.recommended(sc))
_listed("priority_scored_order", "scored", dn.PRIORITY_SCORED, _scored)
_MAXIMA = list(dn._NORMALISED.values())
query("max_over_all", oracle(
    "SELECT store_id, product_id, " + ", ".join(f"max({c}) OVER () AS max_{n}" for n, c in dn._NORMALISED.items())
    + " FROM recommendation WHERE reorder_required", " ".join(f"max_{n}" for n in dn._NORMALISED)))(
    lambda s, d: dn.with_maxima(chain.recommended(chain.build_scenario(s, d))).filter("reorder_required")
    .select(*SERIES_KEY, *[f"max_{n}" for n in dn._NORMALISED]))
query("global_rank", oracle("""
SELECT store_id, product_id, urgency_score,
       row_number() OVER (ORDER BY urgency_score DESC, store_id, product_id) AS priority_rank FROM scored""",
    "urgency_score"))(
    lambda s, d: ordered.global_rank(
        _scored(chain.build_scenario(s, d)).select(*SERIES_KEY, "urgency_score"), al.rank_order(), "priority_rank"))
query("running_total", oracle("""
SELECT store_id, product_id, sum(CAST(final_recommended_quantity AS BIGINT)) OVER (
         ORDER BY urgency_score DESC, store_id, product_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_quantity
FROM scored"""))(
    lambda s, d: ordered.with_running_total(
        ordered.globally_sorted(_scored(chain.build_scenario(s, d)).select(
            *SERIES_KEY, "urgency_score", "final_recommended_quantity"), al.rank_order()),
        F.col("final_recommended_quantity"), "running_quantity").select(*SERIES_KEY, "running_quantity"))

# --- allocation --------------------------------------------------------------

_A1 = ["store_id", "product_id", "decision_date", "urgency_score", "urgency_band", "requested_order_quantity",
       "requested_order_value", "allocated_order_quantity", "allocated_order_value", "funding_status",
       "cumulative_budget_used"]
query("capital_allocation_value", oracle("""
SELECT store_id, product_id, decision_date, urgency_score, urgency_band,
       final_recommended_quantity AS requested_order_quantity, v / 100e0 AS requested_order_value,
       coalesce(final_recommended_quantity * (CAST(g AS DOUBLE) / nullif(v, 0)), 0e0) AS allocated_order_quantity,
       g / 100e0 AS allocated_order_value,
       CASE WHEN g = 0 THEN 'UNFUNDED' WHEN g < v THEN 'PARTIALLY FUNDED' ELSE 'FULLY FUNDED' END AS funding_status,
       least(upto, b) / 100e0 AS cumulative_budget_used
FROM (SELECT *, CASE WHEN upto <= b THEN v WHEN upto - v >= b THEN 0 ELSE b - (upto - v) END AS g FROM (
  SELECT *, CAST(sum(v) OVER (ORDER BY urgency_score DESC, store_id, product_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM (SELECT s.*, CAST(floor(final_order_value * 100e0 + 0.5e0) AS BIGINT) AS v,
               CAST(floor(x.budget * 100e0) AS BIGINT) AS b
        FROM scored s CROSS JOIN shared_budget x WHERE final_recommended_quantity > 0)))""",
    floats(_A1), "decision_date"))(
    lambda s, d: (lambda sc: al.capital_allocation_value(_scored(sc), sc.budget))(chain.build_scenario(s, d)))

_ELIGIBLE = ["priority_rank", "store_id", "product_id", "decision_date", "urgency_score", "urgency_band",
             "minimum_order_quantity", "case_pack_size", "supplier_unit_cost", "requested_quantity",
             "requested_order_value"]
_listed("eligible_orders", "ranked_orders", _ELIGIBLE, lambda sc: al.ranked_orders(_scored(sc)))
query("procurement_allocation", oracle(
    "SELECT * FROM allocation", floats(al.PROCUREMENT_ALLOCATION), "decision_date"))(
    lambda s, d: (lambda sc: al.procurement_allocation(_scored(sc), sc.budget))(chain.build_scenario(s, d)))

query("rank_step_join", oracle("""
SELECT priority_rank, w.left_before / 100e0 AS budget_before_order, w.left_after / 100e0 AS budget_after_order
FROM walked w""", "budget_before_order budget_after_order"))(
    lambda s, d: (lambda sc: al.procurement_allocation(_scored(sc), sc.budget))(chain.build_scenario(s, d))
    .select("priority_rank", "budget_before_order", "budget_after_order"))

_BUDGETS = {"0": 0.0, "100": 100.0, "5000": 5000.0, "default": None}
for _name, _b in _BUDGETS.items():
    TABLES[f"walked_{_name}"] = walk(f"walked_{_name}", str(int(_b * 100)) if _b is not None
                                     else "(SELECT floor(budget * 100e0) FROM shared_budget)")


def _sensitivity(s, d):
    """Every budget reuses the one written ranking."""
    sc = chain.build_scenario(s, d)
    ranked = al.ranked_orders(_scored(sc))
    parts = [
        al.allocate_ranked(ranked, sc.budget if b is None else b).agg(
            F.lit(name).alias("budget"),
            F.coalesce(F.sum("allocated_order_value"), F.lit(0.0)).alias("spent"),
            F.count_if(F.col("allocated_quantity") > 0).alias("funded_orders"))
        for name, b in _BUDGETS.items()
    ]
    return gates.all_of(parts)


query("budget_sensitivity", oracle(" UNION ALL ".join(
    f"SELECT '{n}' AS budget, coalesce(sum(allocated_order_value), 0e0) AS spent, "
    f"count(*) FILTER (WHERE allocated_quantity > 0) AS funded_orders FROM ({allocated(f'walked_{n}')})"
    for n in _BUDGETS), "spent"))(_sensitivity)

# --- control tower -----------------------------------------------------------

query("control_tower", oracle(
    f"SELECT {', '.join(ct.CONTROL_TOWER)} FROM tower", floats(ct.CONTROL_TOWER), "decision_date"))(
    lambda s, d: chain.tower(chain.build_scenario(s, d)).select(*ct.CONTROL_TOWER))

_ENRICHED = [*DECISION_KEY, "urgency_score", "urgency_band", "allocated_quantity", "allocated_order_value",
             "funding_status"]


def _enriched(s, d):
    sc = chain.build_scenario(s, d)
    rows = chain.recommended(sc)
    scored = dn.priority_scored_order(rows)
    return ct.enrich(rows, scored, al.procurement_allocation(scored, sc.budget)).select(*_ENRICHED)


query("left_enrich", oracle(f"SELECT {', '.join(_ENRICHED)} FROM tower", floats(_ENRICHED), "decision_date"))(_enriched)
_RECLASS = [*DECISION_KEY, "control_tower_status", "recommended_action"]
query("overwrite_classification", oracle(f"SELECT {', '.join(_RECLASS)} FROM tower", "", "decision_date"))(
    lambda s, d: _corrected(s, d).select(*_RECLASS))


def _corrected(s, d):
    """A stored mart whose classification was lost for one product in seven and is wrong for all orders that cannot be placed."""
    mart, base = chain.published(s, d)[1], new_path(s, "mart")
    stuck = F.col("reorder_required") & (F.col("final_recommended_quantity") <= 0)
    lost = F.col("product_id") % 7 == 0
    broken_mart = mart.withColumns({
        "control_tower_status": F.when(lost, F.lit(None).cast("string")).when(stuck, "REORDER - UNFUNDED").otherwise(F.col("control_tower_status")),
        "recommended_action": F.when(stuck, ct.ACTIONS["REORDER - UNFUNDED"]).otherwise(F.col("recommended_action"))})
    versions.replace(s, base, {"control_tower": broken_mart})
    return ct.correct_classification(s, base, "control_tower", mart.schema).read("control_tower", mart.schema)


_TOWER_RULES = [
    ("allocation_nonnegative", broken("allocated_quantity >= 0 AND allocated_order_value >= 0")),
    ("allocation_within_feasible", broken("allocated_quantity <= final_recommended_quantity + 1e-8")),
    ("allocation_reaches_moq", broken("allocated_quantity = 0 OR allocated_quantity + 1e-8 >= minimum_order_quantity")),
    ("allocation_whole_packs", broken("allocated_quantity % case_pack_size = 0")),
    ("infeasible_is_constrained", broken("NOT reorder_required OR final_recommended_quantity > 0 "
                                         "OR control_tower_status = 'CONSTRAINED - ESCALATE'")),
    ("value_matches_quantity", broken("abs(allocated_order_value - allocated_quantity * supplier_unit_cost) <= 1e-6")),
]
query("control_tower_gates", oracle(" UNION ALL ".join([
    gate_rows([("decision_rows", "count(*)")], "tower", "(SELECT count(*) // 2 FROM profile)"),
    gate_rows([("budget_exceeded", "CASE WHEN coalesce(sum(allocated_order_value), 0) > max(budget) + 1e-6 "
                                   "OR sum(allocated_order_value) < 0 THEN 1 ELSE 0 END")], "tower CROSS JOIN shared_budget"),
    gate_rows(_TOWER_RULES, "tower")])))(
    lambda s, d: (lambda p: ct.tower_gates(p[1], p[0].size, p[0].budget))(chain.published(s, d)))

query("lineage_join_gate", oracle("""
SELECT count(*) AS joined_rows,
       count(*) FILTER (WHERE abs(t.expected_daily_demand - greatest(f.prediction, 0.01e0)) < 1e-8) AS lineage_rows
FROM tower t JOIN forecast f ON f.store_id = t.store_id AND f.product_id = t.product_id"""))(
    lambda s, d: (lambda p: ct.lineage_gate(p[1].drop("prediction"), p[0].forecast))(chain.published(s, d)))

query("history_until_decision", oracle("""
SELECT f.store_id, f.product_id, count(*) AS days, max(f.dt) AS last_date, sum(f.sale_amount) AS total_sales
FROM fact f JOIN tower t ON f.store_id = t.store_id AND f.product_id = t.product_id
WHERE f.dt <= t.decision_date GROUP BY 1, 2""", "total_sales", "last_date"))(
    lambda s, d: (lambda p: ct.bi_demand_history(p[0].fact, p[1]))(chain.published(s, d)).groupBy(*SERIES_KEY)
    .agg(F.count(F.lit(1)).alias("days"), F.max("dt").alias("last_date"), F.sum("sale_amount").alias("total_sales")))
query("bi_demand_history", oracle("""
SELECT f.store_id, f.product_id, f.dt, f.sale_amount, f.stockout_hours
FROM fact f JOIN tower t ON f.store_id = t.store_id AND f.product_id = t.product_id
WHERE f.dt <= t.decision_date""", "sale_amount", "dt"))(
    lambda s, d: (lambda p: ct.bi_demand_history(p[0].fact, p[1]))(chain.published(s, d)))

_OUTLOOK = [c for c in ct.CONTROL_TOWER[5:] if c not in (
    "reorder_required", "stockout_cost_per_unit", "on_time_delivery_rate", "priority_weight")] + [
    "minimum_order_quantity", "case_pack_size"]
_OUTLOOK_SQL = f"""
SELECT store_id, product_id, DATE '2024-07-02' AS as_of_date, DATE '2024-07-03' AS forecast_date,
       prediction AS predicted_demand, 'rolling_mean_7' AS model_id, 'run-2024-07-02' AS forecast_run_id,
       (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM events WHERE event_type IN ('purchase', 'error')
          AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS generated_at,
       'one_day_level_for_inventory' AS input_policy, {', '.join(_OUTLOOK)}, budget AS scenario_budget
FROM tower CROSS JOIN shared_budget"""


def run_log(s, d, budget):
    """The events as log of runs, one a day, the last of them on the day of the decisions; each starts with its budget."""
    kinds = {"view": "running", "purchase": "success", "error": "failed"}
    events = s.read.parquet(f"{d}/events.parquet").withColumn("day", F.to_date("ts"))
    last = F.broadcast(events.agg(F.max("day").alias("last")))
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    as_of = F.date_add(F.lit(chain.AS_OF).cast("date"), F.datediff("day", "last"))
    return events.crossJoin(last).select(
        F.concat(F.lit("run-"), as_of.cast("string")).alias("run_id"),
        F.when(status.isNotNull(), "run").otherwise("ingest").alias("stage"),
        F.coalesce(status, F.lit("running")).alias("status"), "ts",
        F.when(status == "running", F.to_json(F.struct(F.lit(budget).alias("budget")))).alias("details"))


def outlook(s, d, forecast=None):
    sc, mart = chain.published(s, d)
    rows = ct.bi_forecast_outlook(mart.drop("prediction"), sc.forecast if forecast is None else forecast, t.run_table(run_log(s, d, sc.budget)))
    return rows.withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


query("run_table", oracle("""
SELECT 'run-' || CAST(DATE '2024-07-02' + CAST(CAST(ts AS DATE) - (SELECT max(CAST(ts AS DATE)) FROM events) AS INTEGER) AS VARCHAR) AS run_id,
       strftime(min(ts) FILTER (WHERE event_type = 'view'), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       strftime(max(ts) FILTER (WHERE event_type IN ('purchase', 'error')), '%Y-%m-%d %H:%M:%S.%f') AS finished_at,
       max(CASE event_type WHEN 'view' THEN budget END) AS budget,
       max({'t': ts, 's': CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'success' ELSE 'failed' END}).s AS status
FROM events CROSS JOIN shared_budget WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1""", "budget"))(
    lambda s, d: t.run_table(run_log(s, d, chain.published(s, d)[0].budget)).select(
        "run_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("started_at", "finished_at")],
        F.get_json_object("config", "$.budget").cast("double").alias("budget"), "status"))


query("bi_forecast_outlook", oracle(
    _OUTLOOK_SQL, floats(_OUTLOOK) + " predicted_demand scenario_budget", "as_of_date forecast_date"))(outlook)
query("outlook_join", oracle(f"""
SELECT store_id, product_id, forecast_date, predicted_demand, forecast_date = as_of_date + 1 AS date_ok
FROM ({_OUTLOOK_SQL})""", "predicted_demand", "forecast_date"))(
    lambda s, d: outlook(s, d).select(
        *SERIES_KEY, "forecast_date", "predicted_demand",
        (F.col("forecast_date") == F.date_add("as_of_date", 1)).alias("date_ok")))

# Forecasts lost for some products, without a number for others, twice for some stores.
_LOST = """(SELECT * REPLACE (CASE WHEN product_id % 5 = 0 THEN NULL ELSE predicted_demand END AS predicted_demand)
FROM (SELECT * FROM outlook UNION ALL SELECT * FROM outlook WHERE store_id % 3 = 0) WHERE product_id % 7 <> 0)"""


def _lost(s, d):
    f = chain.published(s, d)[0].forecast.withColumn("prediction", F.when(F.col("product_id") % 5 != 0, F.col("prediction")))
    return outlook(s, d, f.unionByName(f.filter("store_id % 3 = 0")).filter("product_id % 7 <> 0"))


def _outlook_gate_sql(source):
    return f"WITH outlook AS ({_OUTLOOK_SQL}) " + " UNION ALL ".join([
        gate_rows([("outlook_rows", "count(*)")], source, "(SELECT count(*) FROM tower)"),
        gate_rows([("repeated_series", "count(*)")],
                  f"(SELECT store_id, product_id FROM {source} GROUP BY 1, 2 HAVING count(*) > 1)"),
        gate_rows([("forecast_not_next_day", broken("forecast_date = as_of_date + 1")),
                   ("demand_missing", broken("predicted_demand IS NOT NULL")),
                   ("run_not_finished", broken("generated_at IS NOT NULL"))], source)])


query("outlook_gates", oracle(_outlook_gate_sql("outlook")))(
    lambda s, d: ct.outlook_gates(outlook(s, d), chain.published(s, d)[1]))
query("outlook_gates_broken", oracle(_outlook_gate_sql(_LOST)))(
    lambda s, d: ct.outlook_gates(_lost(s, d), chain.published(s, d)[1]))

# Every number again from the inputs beside it, none from another published result.
_SAFETY = """((CASE WHEN target_service_level >= 0.99e0 THEN 2.326e0 WHEN target_service_level >= 0.975e0 THEN 1.960e0 ELSE 1.645e0 END)
 * sqrt(average_lead_time_days * (demand_std * demand_std)
        + (expected_daily_demand * expected_daily_demand) * (lead_time_std_days * lead_time_std_days)))"""
_POSITION = "(on_hand_quantity + on_order_quantity - backorder_quantity)"
_RECONCILED = [(n, broken(f"abs({n} - ({x})) <= 1e-7")) for n, x in (
    ("inventory_position", _POSITION), ("safety_stock", _SAFETY),
    ("reorder_point", f"expected_daily_demand * average_lead_time_days + {_SAFETY}"),
    ("days_of_supply", "on_hand_quantity / expected_daily_demand"),
    ("coverage_gap_days", "greatest(average_lead_time_days - on_hand_quantity / expected_daily_demand, 0)"),
    ("raw_order_quantity", f"greatest(expected_daily_demand * planning_horizon_days + {_SAFETY} - {_POSITION}, 0)"),
)]
_RECONCILED += [
    ("expected_demand", broken("abs(expected_daily_demand - greatest(prediction, 0.01e0)) <= 1e-7")),
    ("funded_reaches_moq", broken("allocated_quantity = 0 OR (allocated_quantity >= minimum_order_quantity "
                                  "AND allocated_quantity <= final_recommended_quantity)")),
    ("funded_whole_packs", broken("allocated_quantity % case_pack_size = 0"))]
query("decision_reconciliation", oracle(gate_rows(_RECONCILED, "tower")))(
    lambda s, d: ct.reconciliation(chain.published(s, d)[1]))

# Wrong by one column each, for products and stores of some numbers.
_WRONG = {"safety_stock": ("product_id", 5, 1.0), "on_hand_quantity": ("product_id", 7, 2.0), "lead_time_std_days": ("product_id", 9, 0.25),
          "prediction": ("product_id", 11, 1.0), "allocated_quantity": ("store_id", 3, 0.5)}


def _perturbed(s, d):
    mart = chain.published(s, d)[1]
    return mart.withColumns({c: F.when(F.col(k) % n == 0, F.col(c) + v).otherwise(F.col(c)) for c, (k, n, v) in _WRONG.items()})


query("decision_reconciliation_perturbed", oracle(gate_rows(_RECONCILED, "(SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {k} % {n} = 0 THEN {c} + {v}e0 ELSE {c} END AS {c}" for c, (k, n, v) in _WRONG.items()) + ") FROM tower)")))(
    lambda s, d: ct.reconciliation(_perturbed(s, d)))

query("mart_totals", oracle("""
SELECT count(*) AS series, sum(allocated_order_value) AS allocated_capital, sum(allocated_quantity) AS funded_quantity,
       count(*) FILTER (WHERE allocated_quantity > 0) AS funded_orders,
       count(*) FILTER (WHERE capital_constrained) AS capital_constrained,
       count(*) FILTER (WHERE capacity_constrained) AS capacity_constrained,
       count(*) FILTER (WHERE shelf_life_constrained) AS shelf_life_constrained FROM tower""",
    "allocated_capital funded_quantity"))(lambda s, d: ct.mart_totals(chain.published(s, d)[1]))
query("mart_status_counts", oracle(
    "SELECT control_tower_status, count(*) AS series FROM tower GROUP BY 1"))(
    lambda s, d: ct.status_counts(chain.published(s, d)[1]))
query("bi_projections", oracle(
    f"SELECT {', '.join(ct.CONTROL_TOWER)} FROM tower", floats(ct.CONTROL_TOWER), "decision_date"))(
    lambda s, d: chain.published(s, d)[1].select(*ct.CONTROL_TOWER))
query("union_all", oracle("""
SELECT stratum, store_id, product_id, mean_daily_demand FROM (
  SELECT 'reorder' AS stratum, store_id, product_id, expected_daily_demand AS mean_daily_demand FROM tower WHERE reorder_required
  UNION ALL SELECT 'steady' AS stratum, store_id, product_id, expected_daily_demand AS mean_daily_demand
  FROM tower WHERE NOT reorder_required)""", "mean_daily_demand"))(
    lambda s, d: (lambda t: t.filter("reorder_required").select(
        F.lit("reorder").alias("stratum"), *SERIES_KEY, F.col("expected_daily_demand").alias("mean_daily_demand"))
        .unionByName(t.filter("NOT reorder_required").select(
            F.lit("steady").alias("stratum"), *SERIES_KEY,
            F.col("expected_daily_demand").alias("mean_daily_demand"))))(chain.published(s, d)[1]))

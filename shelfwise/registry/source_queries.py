"""Scan, ingest, registry, snapshot and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators import compare, gates
from shelfwise.plans import control_tower as ct
from shelfwise.plans import evaluation as ev
from shelfwise.plans import features as ft
from shelfwise.plans import forecast as fc
from shelfwise.registry import chain, inputs, query
from shelfwise.registry.check_queries import FACT_FLOATS, gate_rows
from shelfwise.registry.decision_queries import floats
from shelfwise.registry.forecast_queries import METRICS
from shelfwise.registry.oracle import oracle
from shelfwise.sources import tables as t
from shelfwise.sources.storage import new_path

SOURCES = ["train.parquet", "eval.parquet"]

query("scan_projection", oracle("""
SELECT l_suppkey, l_quantity, l_shipdate::DATE AS ship_date FROM lineitem WHERE l_quantity >= 45""",
    "l_quantity", "ship_date"))(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity >= 45")
    .select("l_suppkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ship_date")))


def _source_files(s, d) -> dict[str, str]:
    """The panel as the two source files a run starts from."""
    rows = inputs.raw_hourly(s, d)
    names = [f.name for f in schemas.SOURCE_RETAIL_DAILY]
    base = new_path(s, "sources")
    rows.select(*names, "source_file").write.partitionBy("source_file").parquet(base)
    return {name: f"{base}/source_file={name}" for name in SOURCES}


def _raw_layer(s, d) -> str:
    raw_path = new_path(s, "raw")
    for name, path in _source_files(s, d).items():
        t.ingest(s, path, name, raw_path)
    return raw_path


_RAW_SQL = """SELECT source_file, count(*) AS rows, sum(sale_amount) AS total_sales, sum(hour_total) AS hourly_sales,
  CAST(sum(out_hours) AS BIGINT) AS out_hours, min(dt) AS first_date, max(dt) AS last_date
FROM (SELECT source_file, store_id, product_id, CAST(dt AS VARCHAR) AS dt, max(day_sales) AS sale_amount,
             sum(sale_amount) AS hour_total, sum(stock_status) AS out_hours FROM hours GROUP BY 1, 2, 3, 4)
GROUP BY source_file"""


def _raw_summary(raw):
    return raw.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("sale_amount").alias("total_sales"),
        F.sum(F.aggregate("hours_sale", F.lit(0.0), lambda a, v: a + v)).alias("hourly_sales"),
        F.sum(F.aggregate("hours_stock_status", F.lit(0).cast("bigint"), lambda a, v: a + v)).alias("out_hours"),
        F.min("dt").alias("first_date"), F.max("dt").alias("last_date"))


query("ingest_raw", oracle(_RAW_SQL, "total_sales hourly_sales"))(
    lambda s, d: _raw_summary(t.read_raw(s, _raw_layer(s, d))))


def _load_twice(s, d):
    raw_path, refused = new_path(s, "raw"), []
    files = _source_files(s, d)
    for name in [*SOURCES, "train.parquet"]:
        try:
            t.ingest(s, files[name], name, raw_path)
        except t.DuplicateLoad:
            refused.append(name)
    counts = t.source_row_counts(s, raw_path)
    return counts.withColumn("reload_refused", F.col("source_file").isin(*refused))


query("dedup_load_guard", oracle("""
SELECT source_file, count(*) AS rows, CAST(21 AS INTEGER) AS columns, source_file = 'train.parquet' AS reload_refused
FROM raw_rows GROUP BY source_file"""))(_load_twice)

query("source_row_counts", oracle("""
SELECT source_file, count(*) AS rows, CAST(18 AS INTEGER) AS columns FROM raw_rows GROUP BY source_file"""))(
    lambda s, d: _stored_counts(s, d))


def _stored_counts(s, d):
    """Counted from the files of the stored layer, none of whose columns is read."""
    path = new_path(s, "staging")
    inputs.staging(s, d).write.partitionBy("source_file").parquet(path)
    return t.source_row_counts(s, path)


_FIELDS = ["store_id", "product_id", "dt", "CAST(round(sale_amount * 16) AS BIGINT)", "stock_hour6_22_cnt"]
_DIGEST = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in _FIELDS)


def _prints(rows):
    cols = [F.col("store_id"), F.col("product_id"), F.col("dt"),
            F.round(F.col("sale_amount") * 16).cast("bigint"), F.col("stock_hour6_22_cnt")]
    return compare.table_fingerprint(rows, ["source_file"], cols)


query("source_fingerprint", oracle(f"""
SELECT source_file, CAST(sum(CAST(('0x' || substr(md5({_DIGEST}), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint,
       count(*) AS row_count FROM raw_rows GROUP BY source_file"""))(
    lambda s, d: _prints(inputs.staging(s, d)))


def _changed_source(s, d):
    """Registered prints of all rows against a source whose last day was edited."""
    stage = inputs.staging(s, d)
    edited = stage.withColumn(
        "sale_amount", F.when(F.col("dt") == F.lit("2024-07-02").cast("date"), F.col("sale_amount") + 1)
        .otherwise(F.col("sale_amount")))
    return compare.registry_changes(_prints(stage), _prints(edited))


query("source_registry_changes", oracle("""
SELECT source_file, CASE WHEN bool_or(dt = DATE '2024-07-02') THEN 'changed' ELSE 'unchanged' END AS status
FROM raw_rows GROUP BY source_file"""))(_changed_source)

_BAG = ["l_partkey", "l_suppkey", "l_linenumber"]
_EDITED = "l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_linenumber + 1 ELSE l_linenumber END AS l_linenumber"


def _two_versions(s, d):
    """All order lines, and all of them with the line numbers of returned ones changed."""
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    changed = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))
    return lines.select(*_BAG), lines.withColumn("l_linenumber", changed).select(*_BAG)


query("reconcile_bag_diff", oracle(f"""
SELECT side, {', '.join(_BAG)}, count(*) AS copies FROM (
(SELECT 'left_only' AS side, * FROM (SELECT {', '.join(_BAG)} FROM lineitem EXCEPT ALL SELECT {_EDITED} FROM lineitem))
UNION ALL
(SELECT 'right_only' AS side, * FROM (SELECT {_EDITED} FROM lineitem EXCEPT ALL SELECT {', '.join(_BAG)} FROM lineitem))) GROUP BY ALL"""))(
    lambda s, d: compare.bag_difference(*_two_versions(s, d), _BAG))


query("except_all", oracle(f"""
SELECT {', '.join(_BAG)}, count(*) AS copies FROM (
  SELECT {', '.join(_BAG)} FROM lineitem EXCEPT ALL SELECT {_EDITED} FROM lineitem) GROUP BY ALL"""))(
    lambda s, d: compare.bag_minus(*_two_versions(s, d), _BAG))


def _raw_matches_source(s, d):
    files = _source_files(s, d)
    raw_path = new_path(s, "raw")
    keep = [f.name for f in schemas.SOURCE_RETAIL_DAILY]
    for name, path in files.items():
        t.ingest(s, path, name, raw_path)
    source = None
    for path in files.values():
        part = s.read.schema(schemas.SOURCE_RETAIL_DAILY).parquet(path)
        source = part if source is None else source.unionByName(part)
    diff = compare.wide_bag_difference(t.read_raw(s, raw_path), source, keep)
    return diff.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("different_rows"))


query("raw_source_adoption", oracle("SELECT count(*) AS different_rows FROM raw_rows WHERE FALSE"))(_raw_matches_source)

def _insert(s, d):
    """Customers added to a stored table of those with orders."""
    path = new_path(s, "customers")
    s.read.parquet(f"{d}/orders.parquet").select("o_custkey").distinct().write.parquet(path)
    new = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"))
    return t.insert_if_absent(new, ["o_custkey"], path)


query("insert_if_absent", oracle("SELECT o_custkey FROM orders UNION SELECT c_custkey AS o_custkey FROM customer"))(_insert)


def _rebuild(s, d):
    """The second build replaces the first, it does not add to it."""
    path, fact = new_path(s, "fact"), inputs.fact(s, d)
    t.rebuild(fact.filter("source_file = 'train.parquet'"), path)
    return t.rebuild(fact, path)


query("rebuild_overwrite", oracle("SELECT * FROM fact", FACT_FLOATS, "dt"))(_rebuild)

# --- evaluation files and forecasts -------------------------------------------


def _evaluation(s, d):
    return ev.rolling_evaluation(ft.features_v2(inputs.staging(s, d)))


def _csv(s, d):
    path = new_path(s, "predictions")
    t.write_predictions_csv(_evaluation(s, d), path)
    return t.read_predictions_csv(s, path)


_EVAL_FLOATS = "actual prediction rolling_prediction"
query("predictions_csv", oracle("SELECT * FROM evaluation", _EVAL_FLOATS, "dt"))(_csv)

_EVAL_CHECKS = " UNION ALL ".join([
    gate_rows([("rows", "count(*)")], "evaluation", "(SELECT count(*) * 7 FROM profile)"),
    gate_rows([("duplicate_keys", "count(*)")],
              "(SELECT 1 FROM evaluation GROUP BY store_id, product_id, dt HAVING count(*) > 1)"),
    gate_rows([("null_values", "count(*) FILTER (WHERE actual IS NULL OR prediction IS NULL)"),
               ("dates_in_range", "count(*) FILTER (WHERE dt NOT BETWEEN DATE '2024-06-26' AND DATE '2024-07-02')"),
               *[(c, f"count(*) FILTER (WHERE isnan({c}) OR isinf({c}) OR {c} < 0)") for c in _EVAL_FLOATS.split()]],
              "evaluation")])


def _series(s, d) -> int:
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    return lines.selectExpr("l_suppkey div 5 AS a", "l_partkey % 40 AS b").distinct().count()


def _checks(rows, n):
    return ev.evaluation_gate(rows, n * 7, "2024-06-26", "2024-07-02")


query("evaluation_gates", oracle(_EVAL_CHECKS))(lambda s, d: _checks(_csv(s, d), _series(s, d)))


def _import_cases(s, d):
    """First load, identical reload, and a load of rows with one day changed."""
    base, rows = _loads(s, d)
    cases = s.createDataFrame(rows, "`case` string, old_rows long, action string")
    stored = t.stored_evaluation(s, base).agg(F.count(F.lit(1)).alias("new_rows"))
    return cases.crossJoin(F.broadcast(stored)).withColumn("failed_checks", F.lit(0).cast("bigint"))


def _loads(s, d):
    """Where the evaluation is stored after the three loads, and what each of them did."""
    new, n, base = _csv(s, d), _series(s, d), new_path(s, "evaluation")
    other = new.withColumn("actual", F.when(F.col("dt") == F.lit("2024-07-02").cast("date"), F.col("actual") + 1)
                           .otherwise(F.col("actual")))
    rows = []
    for case, what in (("first", new), ("same", new), ("changed", other)):
        have = t.stored_evaluation(s, base).count()
        try:
            action = t.load_evaluation(s, base, what, lambda loaded: _checks(loaded, n))
        except t.EvaluationChanged:
            action = "refuse"
        rows.append((case, have, action))
    return base, rows


query("evaluation_import", oracle("""
SELECT c."case", n AS new_rows, CASE WHEN c."case" = 'first' THEN 0 ELSE n END AS old_rows,
       CAST(0 AS BIGINT) AS failed_checks, c.action FROM (SELECT count(*) AS n FROM evaluation)
CROSS JOIN (VALUES ('first', 'load'), ('same', 'keep'), ('changed', 'refuse')) c("case", action)"""))(_import_cases)

query("evaluation_load", oracle("SELECT * FROM evaluation", _EVAL_FLOATS, "dt"))(
    lambda s, d: t.stored_evaluation(s, _loads(s, d)[0]).drop("source_print"))
query("evaluation_load_metrics", oracle(
    f"SELECT 'prediction' AS model, {METRICS} FROM (SELECT actual AS a, prediction AS p FROM evaluation)", "mae rmse wape"))(
    lambda s, d: ev.compare_predictions(
        t.stored_evaluation(s, _loads(s, d)[0]), "actual", {"prediction": "prediction"}))

query("evaluation_view", oracle("""
SELECT store_id, product_id, dt, actual, prediction, rolling_prediction, 'rolling mean holdout' AS model_version
FROM evaluation""", _EVAL_FLOATS, "dt"))(
    lambda s, d: _evaluation(s, d).withColumn("model_version", F.lit("rolling mean holdout")))

_FORECAST_SQL = """SELECT store_id, product_id, DATE '2024-07-02' AS as_of_date, DATE '2024-07-03' AS target_date,
  prediction, 'rolling_mean_7' AS model_id, 'one_day_level_for_inventory' AS input_policy"""


def _forecasts(s, d):
    """Two runs appended, the second one read back."""
    path, fact = new_path(s, "forecast"), inputs.fact(s, d)
    for run in ("run-1", "run-2"):
        t.append_forecast(fc.rolling_forecast(fact, chain.AS_OF, run), path)
    return t.read_forecast(s, path, "run-2")


query("append_forecast", oracle(_FORECAST_SQL + ", 'run-2' AS run_id FROM forecast", "prediction",
                                "as_of_date target_date"))(_forecasts)
query("next_day_forecast", oracle(_FORECAST_SQL + f", '{chain.RUN_ID}' AS run_id FROM forecast", "prediction",
                                  "as_of_date target_date"))(
    lambda s, d: fc.rolling_forecast(inputs.fact(s, d), chain.AS_OF, chain.RUN_ID))

# --- audit over the event log -------------------------------------------------

_LATE = "2024-01-25 00:00:00"


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


query("run_audit_latest", oracle(f"""
SELECT user_id, event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '{_LATE}' THEN 'failed' ELSE event_type END
         AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, props
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""))(
    lambda s, d: t.close_abandoned(
        t.latest_state(_events(s, d), ["user_id"], ["ts", "event_id"], ["event_type", "props"]),
        "event_type", "view", _LATE).select(
        "user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "props"))
query("stage_audit_latest", oracle("""
SELECT user_id, event_type, max(event_id) FILTER (WHERE n = 1) AS event_id,
       max(props) FILTER (WHERE n = 1) AS props
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
GROUP BY 1, 2"""))(
    lambda s, d: t.latest_state(_events(s, d), ["user_id", "event_type"], ["ts", "event_id"], ["props"])
    .select("user_id", "event_type", "event_id", "props"))
query("latest_per_key", oracle("""
SELECT event_type, event_id, user_id, value
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
WHERE n = 1""", "value"))(
    lambda s, d: t.latest_state(_events(s, d), ["event_type"], ["ts", "event_id"], ["user_id", "value"])
    .select("event_type", "event_id", "user_id", "value"))
query("latest_success_run", oracle("""
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, json_extract_string(props, '$.k') AS k
FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1"""))(
    lambda s, d: t.latest_success(_events(s, d), "event_type", "purchase", ["ts", "event_id"], "props", "k").select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "k"))

# --- snapshot -----------------------------------------------------------------


def _publish_twice(s, d):
    """A good run, then a run whose gate fails: readers still see the first."""
    sc, mart = chain.published(s, d)
    base = new_path(s, "marts")
    checks = lambda stored: ct.tower_gates(stored["control_tower"], sc.size, sc.budget)
    t.publish(s, base, "good", {"control_tower": mart}, checks)
    overspent = mart.withColumn("allocated_order_value", F.col("allocated_order_value") + 1)
    try:
        t.publish(s, base, "bad", {"control_tower": overspent}, checks)
    except gates.GateFailure:
        pass
    return t.read_published(s, base, "control_tower", mart.schema).withColumn(
        "snapshot", F.lit(t.current_run(s, base)))


_SNAP = [*schemas.DECISION_KEY, "control_tower_status", "allocated_quantity", "allocated_order_value"]
query("publish_snapshot", oracle(
    f"SELECT {', '.join(_SNAP)}, 'good' AS snapshot FROM tower", floats(_SNAP), "decision_date"))(
    lambda s, d: _publish_twice(s, d).select(*_SNAP, "snapshot"))

"""One batch run from source files to the published control tower.

Stages: ingest, warehouse, model, forecast, publish, and the check of the outlook that BI reads. Each stage appends its
start and end to the audit log; a run that stops anywhere leaves the previous
publication in place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise import schemas
from shelfwise.operators import compare, gates
from shelfwise.plans import (
    allocation,
    boosting,
    control_tower,
    decisions,
    features,
    profiling,
    scenario,
    warehouse,
)
from shelfwise.sources import tables


@dataclass(frozen=True)
class Settings:
    as_of: str
    sample_size: int = 1000
    budget: float = 300_000.0
    seed: int = 42
    future_holiday_flag: int = 0
    regenerate_scenario: bool = False
    abandoned_after_hours: float = 24.0
    weights: Mapping[str, float] = field(default_factory=lambda: dict(decisions.WEIGHTS))
    boosting: boosting.Params = boosting.LeafWise()

    def __post_init__(self) -> None:
        if not math.isfinite(self.budget) or self.budget < 0:
            raise ValueError("budget must be finite and not negative")
        if abs(sum(self.weights.values()) - 1) > 1e-9 or min(self.weights.values()) < 0:
            raise ValueError("weights must be non-negative and sum to 1")
        if self.sample_size < 1 or self.future_holiday_flag not in (0, 1):
            raise ValueError("sample_size must be positive and the holiday flag 0 or 1")


class Run:
    """Paths and audit log of one run below a base folder."""

    def __init__(self, spark: SparkSession, base: str, run_id: str, settings: Settings) -> None:
        self.spark, self.base, self.run_id, self.settings = spark, base.rstrip("/"), run_id, settings

    def log(self, stage: str, status: str, details: dict | None = None) -> None:
        text = json.dumps(details, default=str) if details is not None else None
        row = (self.run_id, stage, status, datetime.now(timezone.utc), text)
        self.spark.createDataFrame([row], schemas.RUN_EVENT).write.mode("append").parquet(f"{self.base}/audit")

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        details: dict = {}
        self.log(name, "running")
        try:
            yield details
        except BaseException as error:
            self.log(name, "failed", {"error": str(error)[:500]})
            raise
        self.log(name, "success", details)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        return tables.rebuild(df, f"{self.base}/layers/run_id={self.run_id}/{name}")


def audit_state(spark: SparkSession, base: str) -> DataFrame:
    """Current status per run and stage."""
    events = spark.read.schema(schemas.RUN_EVENT).parquet(f"{base}/audit")
    return tables.latest_state(events, ["run_id", "stage"], ["ts"], ["status", "details"])


def close_abandoned(run: Run) -> list[str]:
    """Log the failure of runs and stages that have been running since before the cutoff; returns those runs."""
    if not tables.path_exists(run.spark, f"{run.base}/audit"):
        return []
    state = audit_state(run.spark, run.base)
    cutoff = datetime.now(timezone.utc) - timedelta(hours=run.settings.abandoned_after_hours)
    closed = tables.close_abandoned(state.withColumn("was", F.col("status")), "status", "running", cutoff.isoformat())
    late = closed.filter("was = 'running' AND status = 'failed'").select("run_id", "stage", "status").withColumns({
        "ts": F.lit(datetime.now(timezone.utc)), "details": F.lit(json.dumps({"error": "abandoned"}))})
    found = sorted({r["run_id"] for r in late.select("run_id").distinct().collect()})  # runs, not rows of tables
    if found:
        late.select(*[f.name for f in schemas.RUN_EVENT]).write.mode("append").parquet(f"{run.base}/audit")
    return found


def ingest(run: Run, sources: Mapping[str, str], details: dict) -> DataFrame:
    """Load new sources; refuse a source whose content changed since its first load."""
    spark, raw_path, registry_path = run.spark, f"{run.base}/raw", f"{run.base}/source_registry"
    names = [f.name for f in schemas.SOURCE_RETAIL_DAILY]
    cols = [F.col(n) for n in names]
    for name, path in sources.items():
        rows = spark.read.schema(schemas.SOURCE_RETAIL_DAILY).parquet(path).withColumn("source_file", F.lit(name))
        now = compare.table_fingerprint(rows, ["source_file"], cols)
        known = spark.createDataFrame([], schemas.SOURCE_REGISTRY)
        if tables.path_exists(spark, registry_path):
            known = spark.read.schema(schemas.SOURCE_REGISTRY).parquet(registry_path).filter(
                F.col("source_file") == name)
        status = compare.registry_changes(known, now).first()["status"]
        if status in ("changed", "missing"):
            raise ValueError(f"{name} is {status} since it was first loaded")
        have = known.select("row_count").first()
        if not tables.already_loaded(spark, raw_path, name, have["row_count"] if have else None):
            tables.ingest(spark, path, name, raw_path)
        if status == "new":
            # What is registered is what was stored, row for row, also when the raw rows are from a run that was lost.
            loaded = tables.read_raw(spark, raw_path).filter(F.col("source_file") == name)
            different = compare.bag_difference(loaded, rows, names).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
            if different:
                raise ValueError(f"{name}: {different} rows differ between source and raw layer")
            now.select(*[f.name for f in schemas.SOURCE_REGISTRY]).write.mode("append").parquet(registry_path)
        details[name] = "loaded" if status == "new" else "reused"
    return tables.read_raw(spark, raw_path)


def build_warehouse(run: Run, raw: DataFrame, details: dict) -> dict[str, DataFrame]:
    shape = profiling.array_shapes(raw).filter("length <> 24").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_with_bad_arrays"))
    gates.require(gates.unpivot_counts(shape))
    registry = run.spark.read.schema(schemas.SOURCE_REGISTRY).parquet(f"{run.base}/source_registry")
    rows = registry.agg(F.sum("row_count")).first()[0]
    expected = {"rows": rows, **{k: raw.select(c).distinct().count() for k, c in (
        ("products", "product_id"), ("stores", "store_id"), ("dates", "dt"))}}
    shapes: dict[str, StructType] = {}

    def with_features(t: Mapping[str, DataFrame]) -> DataFrame:
        made = features.features_v3(t["staging"])
        shapes["features"] = made.schema
        return made

    made = warehouse.build(
        run.spark, f"{run.base}/warehouse", warehouse.staging(raw), expected, {"features": with_features},
        lambda t: gates.row_count_gate(t["features"], "feature_rows", rows))
    details.update(rows=rows, version=made.number)
    return {n: made.read(n, schema) for n, schema in (warehouse.LAYER_SCHEMAS | shapes).items()}


def build_scenario(run: Run, fact: DataFrame, details: dict) -> dict[str, DataFrame]:
    """Reuse the stored scenario, or generate it; never silently change it."""
    s, spark = run.settings, run.spark
    declared = {"inventory": schemas.INVENTORY_POSITION, "supplier": schemas.SUPPLIER_POLICY,
                "priority": schemas.PRODUCT_PRIORITY}
    base = f"{run.base}/scenario"
    stored = tables.current_run(spark, base)
    if stored and not s.regenerate_scenario:
        inventory = tables.read_published(spark, base, "inventory", declared["inventory"])
        action = scenario.scenario_action(inventory, s.sample_size, s.as_of).first()["action"]
        if action != "reuse":
            raise ValueError("the stored scenario has another size or date")
        details["scenario"] = "reused"
    else:
        train = features.in_period(fact.filter("source_file = 'train.parquet'"), None, s.as_of)
        profiles = run.table("profiles", scenario.series_profiles(train))
        selected = run.table("selected", scenario.sample_series(profiles, s.sample_size, s.seed))
        parts = {
            "inventory": scenario.inventory_position(selected, s.as_of, s.seed),
            "supplier": scenario.supplier_policy(selected, s.seed),
            "priority": scenario.product_priority(selected, s.seed),
        }
        tables.publish(spark, base, run.run_id, parts, lambda t: scenario.scenario_gates(
            t["inventory"], t["supplier"], t["priority"]))
        details["scenario"] = "generated"
    return {n: tables.read_published(spark, base, n, schema) for n, schema in declared.items()}


def outlook(spark: SparkSession, base: str) -> DataFrame:
    """The published decisions with their forecasts and the time their run ended, as BI reads them."""
    run_id, folder = tables.current_run(spark, f"{base}/marts"), tables.current_folder(spark, f"{base}/marts")
    if run_id is None:
        raise ValueError("nothing is published yet")
    events = spark.read.schema(schemas.RUN_EVENT).parquet(f"{base}/audit")
    return control_tower.bi_forecast_outlook(
        spark.read.parquet(f"{folder}/control_tower").drop("prediction"),
        tables.read_forecast(spark, f"{base}/forecast", run_id), tables.run_table(events))


def check_outlook(run: Run, details: dict) -> None:
    rows = outlook(run.spark, run.base)
    folder = tables.current_folder(run.spark, f"{run.base}/marts")
    gates.require(control_tower.outlook_gates(rows, run.spark.read.parquet(f"{folder}/control_tower")))
    details["rows"] = rows.count()


def publish(run: Run, layers: dict[str, DataFrame], forecast: DataFrame, details: dict) -> None:
    s = run.settings
    parts = build_scenario(run, layers["fact"], details)
    train = features.in_period(layers["fact"].filter("source_file = 'train.parquet'"), None, s.as_of)
    joined = decisions.scenario_join(
        parts["inventory"], parts["supplier"], parts["priority"], scenario.series_profiles(train), forecast)
    rows = run.table("recommended", decisions.order_recommendation(decisions.inventory_decision(joined)))
    decided = decisions.with_urgency(rows, s.weights)
    funded = run.table("allocation", allocation.procurement_allocation(decided, s.budget))

    def checks(stored: dict[str, DataFrame]) -> DataFrame:
        mart = stored["control_tower"]
        lineage = control_tower.lineage_gate(mart.drop("prediction"), forecast)
        return gates.all_of([
            control_tower.tower_gates(mart, s.sample_size, s.budget),
            gates.unpivot_counts(lineage.select("lineage_rows"), s.sample_size),
        ])

    tables.publish(run.spark, f"{run.base}/marts", run.run_id, {
        "inventory_decision": rows.select(*decisions.INVENTORY_DECISION),
        "order_recommendation": rows.select(*decisions.ORDER_RECOMMENDATION),
        "priority_scored_order": decided.filter("reorder_required").select(*decisions.PRIORITY_SCORED),
        "procurement_allocation": funded,
        "control_tower": control_tower.control_tower(decided, funded),
    }, checks)


def run(spark: SparkSession, sources: Mapping[str, str], base: str, run_id: str, settings: Settings) -> None:
    r = Run(spark, base, run_id, settings)
    close_abandoned(r)
    r.log("run", "running", asdict(settings))
    try:
        with r.stage("ingest") as details:
            raw = ingest(r, sources, details)
        with r.stage("warehouse") as details:
            layers = build_warehouse(r, raw, details)
        with r.stage("model") as details:
            frame = r.table("training", features.training_frame(layers["features"], settings.as_of))
            gates.require(features.training_gate(frame))
            model, model_id, action = boosting.fit_or_load(
                frame, "V3C", settings.as_of, f"{base}/models", settings.boosting)
            details.update(model_id=model_id, action=action)
        with r.stage("forecast") as details:
            gates.require(features.history_gate(layers["staging"], settings.as_of))
            ahead = features.forward_features(layers["staging"], settings.as_of, settings.future_holiday_flag)
            scored = boosting.next_day_forecast(
                model, ahead, settings.as_of, run_id, model_id, settings.future_holiday_flag)
            tables.append_forecast(scored, f"{base}/forecast")
            forecast = tables.read_forecast(spark, f"{base}/forecast", run_id)
            gates.require(gates.finite_nonnegative(forecast, ["prediction"]))
            details["rows"] = forecast.count()
        with r.stage("publish") as details:
            publish(r, layers, forecast, details)
    except BaseException:
        r.log("run", "failed")
        raise
    r.log("run", "success", {"model_id": model_id, "as_of": settings.as_of})
    with r.stage("outlook") as details:  # reads the end of the run, so it follows it
        check_outlook(r, details)

"""The decision chain over the given tables, step by step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans import allocation, control_tower, decisions, forecast, scenario
from shelfwise.registry import inputs
from shelfwise.sources.storage import written

AS_OF = "2024-07-02"
RUN_ID = "run-2024-07-02"
BUDGET_PER_SERIES = 12.5


@dataclass
class Scenario:
    fact: DataFrame
    profiles: DataFrame
    selected: DataFrame
    inventory: DataFrame
    supplier: DataFrame
    priority: DataFrame
    forecast: DataFrame
    size: int

    @property
    def budget(self) -> float:
        return BUDGET_PER_SERIES * self.size


def profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Written fact columns the chain reads, and written series profiles."""
    fact = written(
        inputs.fact(spark, sf_dir).select(
            "store_id", "product_id", "dt", "sale_amount", "stockout_hours", "source_file"), "fact")
    stats = scenario.series_profiles(fact.filter("source_file = 'train.parquet'"))
    return fact, written(stats, "profiles")


def build_scenario(spark: SparkSession, sf_dir: str) -> Scenario:
    fact, stats = profiles(spark, sf_dir)
    size = stats.count() // 2
    selected = written(scenario.sample_series(stats, size), "selected")
    return Scenario(
        fact, stats, selected,
        scenario.inventory_position(selected, AS_OF),
        scenario.supplier_policy(selected),
        scenario.product_priority(selected),
        forecast.rolling_forecast(fact, AS_OF, RUN_ID),
        size,
    )


def decided(sc: Scenario) -> DataFrame:
    joined = decisions.scenario_join(sc.inventory, sc.supplier, sc.priority, sc.profiles, sc.forecast)
    return decisions.inventory_decision(joined)


def recommended(sc: Scenario) -> DataFrame:
    """Written once: the maxima, the ranking and the mart read it."""
    return written(decisions.order_recommendation(decided(sc)), "recommended")


def tower(sc: Scenario, budget: float | None = None) -> DataFrame:
    """Control tower rows with lineage and the procurement columns the gates read."""
    rows = decisions.with_urgency(recommended(sc))
    funded = allocation.procurement_allocation(rows, sc.budget if budget is None else budget)
    return control_tower.control_tower(rows, funded)


_PUBLISHED: dict[tuple[str, str, tuple], tuple[Scenario, DataFrame]] = {}


def input_files(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that the mart is made from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def published(spark: SparkSession, sf_dir: str) -> tuple[Scenario, DataFrame]:
    """The written mart that BI queries read, built once per session and state of the input files."""
    key = (spark.sparkContext.applicationId, sf_dir, input_files(spark, sf_dir))
    if key not in _PUBLISHED:
        sc = build_scenario(spark, sf_dir)
        _PUBLISHED[key] = (sc, written(tower(sc), "control_tower"))
    return _PUBLISHED[key]

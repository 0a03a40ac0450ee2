"""The whole run at the smallest scale: stages, reuse, refusal, audit."""

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.plans import batch_run
from shelfwise.plans.boosting import Boosting
from shelfwise.sources import panel, storage, tables

AS_OF = "2024-07-02"


@pytest.fixture(scope="module")
def sources(spark, sf_dir):
    names = [f.name for f in schemas.SOURCE_RETAIL_DAILY]
    base = storage.new_path(spark, "sources")
    panel.source_rows(spark, sf_dir, hourly=True).select(*names, "source_file").write.partitionBy(
        "source_file").parquet(base)
    return {n: f"{base}/source_file={n}" for n in ("train.parquet", "eval.parquet")}


def settings(**change):
    base = dict(as_of=AS_OF, sample_size=20, budget=300.0, boosting=Boosting(iterations=2, depth=3))
    return batch_run.Settings(**{**base, **change})


def mart(spark, base):
    folder = f"{tables.current_folder(spark, f'{base}/marts')}/control_tower"
    return spark.read.parquet(folder)


def test_full_run_then_reuse_then_refusal(spark, sources):
    base = storage.new_path(spark, "run")
    batch_run.run(spark, sources, base, "first", settings())
    tower = mart(spark, base)
    assert tower.count() == 20
    assert tower.agg(F.sum("allocated_order_value")).first()[0] <= 300.0
    first = {tuple(r) for r in tower.select("store_id", "product_id", "allocated_quantity", "control_tower_status").collect()}

    batch_run.run(spark, sources, base, "second", settings())
    again = mart(spark, base)
    assert {tuple(r) for r in again.select(
        "store_id", "product_id", "allocated_quantity", "control_tower_status").collect()} == first
    state = {(r["run_id"], r["stage"]): r for r in batch_run.audit_state(spark, base).collect()}
    assert {r["status"] for r in state.values()} == {"success"}
    assert '"reused"' in state[("second", "model")]["details"]
    # The outlook carries the end of its run and the budget the run started with.
    assert state[("second", "outlook")]["details"] == '{"rows": 20}'
    ended = {(r["generated_at"], r["scenario_budget"], r["forecast_run_id"]) for r in batch_run.outlook(spark, base).collect()}
    assert ended == {(state[("second", "run")]["ts"], 300.0, "second")}
    assert '"train.parquet": "reused"' in state[("second", "ingest")]["details"]

    with pytest.raises(ValueError, match="another size"):
        batch_run.run(spark, sources, base, "third", settings(sample_size=12))
    assert tables.current_run(spark, f"{base}/marts") == "second"
    state = {(r["run_id"], r["stage"]): r["status"] for r in batch_run.audit_state(spark, base).collect()}
    assert state[("third", "publish")] == state[("third", "run")] == "failed"

    changed = dict(sources)
    changed["eval.parquet"] = sources["train.parquet"]
    with pytest.raises(ValueError, match="changed"):
        batch_run.run(spark, changed, base, "fourth", settings())


def test_settings_are_checked():
    for bad in (dict(budget=-1.0), dict(budget=float("nan")), dict(budget=float("inf")),
                dict(weights={"coverage": 0.5}), dict(sample_size=0)):
        with pytest.raises(ValueError):
            settings(**bad)
    assert settings(budget=0.0).budget == 0.0

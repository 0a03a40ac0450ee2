import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators import gates
from shelfwise.sources import panel, storage, tables


def one_source(spark, sf_dir):
    path = storage.new_path(spark, "src")
    names = [f.name for f in schemas.SOURCE_RETAIL_DAILY]
    panel.source_rows(spark, sf_dir, hourly=True).select(*names).write.parquet(path)
    return path


def test_a_source_is_loaded_once(spark, sf_dir):
    path, raw = one_source(spark, sf_dir), storage.new_path(spark, "raw")
    assert not tables.already_loaded(spark, raw, "a.parquet")
    tables.ingest(spark, path, "a.parquet", raw)
    with pytest.raises(tables.DuplicateLoad):
        tables.ingest(spark, path, "a.parquet", raw)
    tables.ingest(spark, path, "b.parquet", raw)
    got = {r["source_file"]: r["rows"] for r in tables.source_row_counts(spark, raw).collect()}
    assert got == {"a.parquet": 7760, "b.parquet": 7760}


def test_panel_is_gap_free_and_consistent(spark, sf_dir):
    rows = panel.source_rows(spark, sf_dir, hourly=True)
    r = rows.groupBy("store_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dt").alias("d")).agg(F.min("n"), F.max("n"), F.min("d")).first()
    assert tuple(r) == (97, 97, 97)
    bad = rows.filter(F.col("sale_amount") != F.aggregate("hours_sale", F.lit(0.0), lambda a, v: a + v))
    assert bad.count() == 0


def test_failed_publication_leaves_the_old_snapshot(spark):
    base = storage.new_path(spark, "marts")
    assert tables.current_run(spark, base) is None
    good, bad = spark.range(3), spark.range(4)
    three = lambda t: gates.row_count_gate(t["m"], "rows", 3)
    tables.publish(spark, base, "one", {"m": good}, three)
    with pytest.raises(gates.GateFailure):
        tables.publish(spark, base, "two", {"m": bad}, three)
    assert tables.current_run(spark, base) == "one"
    assert tables.read_published(spark, base, "m", good.schema).count() == 3
    tables.publish(spark, base, "three", {"m": good}, three)
    assert tables.current_run(spark, base) == "three"
    tables.publish(spark, base, "two", {"m": good}, three)  # a failed run can be tried again
    assert tables.current_run(spark, base) == "two"
    assert tables.read_published(spark, base, "m", good.schema).count() == 3


def test_latest_state_and_abandoned_runs(spark):
    ev = spark.createDataFrame(
        [("r1", "a", 1, "running"), ("r1", "a", 2, "success"), ("r2", "a", 1, "running"), ("r3", "a", 9, "running")],
        "run string, stage string, n int, status string").withColumn("ts", F.timestamp_seconds(F.col("n") * 86400))
    state = tables.latest_state(ev, ["run", "stage"], ["ts"], ["status"])
    closed = tables.close_abandoned(state, "status", "running", "1970-01-05 00:00:00")
    assert {r["run"]: r["status"] for r in closed.collect()} == {"r1": "success", "r2": "failed", "r3": "running"}


def test_rebuild_replaces_and_insert_only_adds(spark):
    path = storage.new_path(spark, "t")
    tables.rebuild(spark.range(5), path)
    assert tables.rebuild(spark.range(2), path).count() == 2
    new = spark.createDataFrame([(1,), (7,), (7,)], "id long")
    for _ in range(2):  # the second time there is nothing to add
        table = tables.insert_if_absent(new, ["id"], path)
        assert sorted(r["id"] for r in table.collect()) == [0, 1, 7]


def test_discard_removes_only_this_application(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda s: str(tmp_path))
    mine = storage.written(spark.range(3), "x")
    other = f"{tmp_path}/tables/another/x"
    spark.range(2).write.parquet(other)
    assert mine.count() == 3
    storage.discard(spark)
    assert not tables.path_exists(spark, f"{tmp_path}/tables/{spark.sparkContext.applicationId}")
    assert spark.read.parquet(other).count() == 2


def test_shared_dir_comes_from_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_hours_move_as_narrow_rows(spark, sf_dir):
    """Arrays of 24 were shuffled and sorted, and spilled; every one is now made in the row that leaves."""
    plan = panel.source_rows(spark, sf_dir, hourly=True)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ObjectHashAggregate"):]
    assert "CASE WHEN (hour" not in below and "hours_sale" not in below


def test_hours_of_odd_lines(spark, tmp_path):
    """An hour is null only where no other line of the cell says 0; lines without an hour count for the day alone."""
    lines = [(24, 40, 5, None, 0.1), (24, 41, 5, 16.0, 0.1), (25, 41, 5, None, 0.3), (49, 41, 5, 32.0, None), (None, 41, 5, 8.0, 0.1), (26, 42, 5, 4.0, 0.1)]
    path = str(tmp_path)
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double").withColumn(
        "l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{path}/lineitem.parquet")
    rows = panel.source_rows(spark, path, hourly=True)
    got = {r["product_id"]: (r["sale_amount"], r["hours_sale"]) for r in rows.filter("dt = '2024-03-28'").collect()}
    zero = [0.0] * 24
    assert got == {0: (None, [None] + zero[1:]), 1: (3.5, [1.0, 2.0] + zero[2:]), 2: (0.25, [0.0, 0.0, 0.25] + zero[3:])}
    assert rows.count() == 3 * panel.DAYS and rows.filter("dt > '2024-03-28'").select("hours_sale").distinct().first()[0] == zero

"""Versioned tables, conditional corrections, gated layers and loads."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfwise import schemas
from shelfwise.operators import gates
from shelfwise.plans import control_tower as ct
from shelfwise.plans import profiling, warehouse
from shelfwise.registry import chain, inputs
from shelfwise.sources import storage, tables, versions

IDS = StructType([StructField("id", LongType()), StructField("kind", StringType())])


def rows(spark, n, kind="a"):
    return spark.range(n).withColumn("kind", F.lit(kind)).repartitionByRange(4, "id")


def ids(snapshot, table="t"):
    return sorted(tuple(r) for r in snapshot.read(table, IDS).collect())


def test_readers_keep_their_version(spark):
    base = storage.new_path(spark, "v")
    assert versions.snapshot(spark, base) is None
    first = versions.replace(spark, base, {"t": rows(spark, 3), "u": rows(spark, 1)})
    second = versions.replace(spark, base, {"t": rows(spark, 2, "b")})
    assert (first.number, second.number) == (1, 2) and versions.numbers(spark, base) == [1, 2]
    assert ids(first) == [(0, "a"), (1, "a"), (2, "a")] and ids(second) == [(0, "b"), (1, "b")]
    assert second.files["u"] == first.files["u"]
    for n, want in ((1, first), (2, second), (None, second)):
        assert versions.snapshot(spark, base, n).files == want.files


def test_a_lost_build_leaves_the_old_tables(spark, monkeypatch):
    base = storage.new_path(spark, "v")
    versions.replace(spark, base, {"t": rows(spark, 3)})

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_claim", lost)
        with pytest.raises(RuntimeError, match="lost"):
            versions.replace(spark, base, {"t": rows(spark, 9)})
        with pytest.raises(RuntimeError, match="lost"):
            tables.rebuild(rows(spark, 9), base)
    assert len(ids(versions.snapshot(spark, base))) == 3
    with pytest.raises(gates.GateFailure):
        versions.replace(spark, base, {"t": rows(spark, 9)}, lambda t, _: gates.row_count_gate(t["t"], "rows", 8))
    assert len(ids(versions.snapshot(spark, base))) == 3
    assert versions.replace(spark, base, {"t": rows(spark, 9)}).number == 2


def test_the_second_of_two_writers_is_refused(spark, monkeypatch):
    base = storage.new_path(spark, "v")
    held = versions.replace(spark, base, {"t": rows(spark, 3)})
    versions.replace(spark, base, {"t": rows(spark, 4)})
    with pytest.raises(versions.VersionConflict):
        versions._commit(spark, base, held, held.files)
    now = versions.snapshot(spark, base)
    versions._claim(spark, f"{base}/versions/0000000003", "")  # a writer between claim and line
    with pytest.raises(versions.VersionConflict):
        versions._commit(spark, base, now, now.files)
    with pytest.raises(versions.VersionConflict):
        versions._claim(spark, f"{base}/versions/0000000003", "x")
    assert versions.snapshot(spark, base).number == 2
    monkeypatch.setattr(versions, "CLAIM_SECONDS", -3600)  # that writer was lost
    assert versions._commit(spark, base, now, now.files).number == 4
    assert versions.snapshot(spark, base).number == 4


def test_an_update_rewrites_only_files_with_changed_rows(spark):
    base = storage.new_path(spark, "v")
    held = versions.replace(spark, base, {"t": rows(spark, 40)})
    assert len(held.files["t"]) == 4
    same = versions.update(spark, base, "t", IDS, F.col("id") > 99, {"kind": F.lit("x")})
    assert same.number == held.number
    assert versions.update(spark, base, "t", IDS, F.lit(None).cast("boolean"), {"kind": F.lit("x")}).number == held.number
    now = versions.update(spark, base, "t", IDS, F.col("id") == 17, {"kind": F.lit("x")})
    assert len({*held.files["t"]} & {*now.files["t"]}) == 3 and len(now.files["t"]) == 4
    assert ids(now) == [(i, "x" if i == 17 else "a") for i in range(40)]
    assert ids(held) == [(i, "a") for i in range(40)]


def test_the_correction_touches_wrong_rows_only(spark, sf_dir):
    _, mart = chain.published(spark, sf_dir)
    base = storage.new_path(spark, "mart")
    wrong = mart.orderBy("store_id", "product_id").first()
    at = (F.col("store_id") == wrong["store_id"]) & (F.col("product_id") == wrong["product_id"])
    stored = mart.withColumn("control_tower_status", F.when(at, "?").otherwise(F.col("control_tower_status")))
    held = versions.replace(spark, base, {"m": stored.repartitionByRange(5, "store_id", "product_id")})
    now = ct.correct_classification(spark, base, "m", mart.schema)
    assert len({*held.files["m"]} & {*now.files["m"]}) == len(held.files["m"]) - 1
    plain = lambda df: sorted(map(str, df.select(*sorted(mart.columns)).collect()))
    assert plain(now.read("m", mart.schema)) == plain(mart)
    assert ct.correct_classification(spark, base, "m", mart.schema).number == now.number


def test_an_evaluation_is_loaded_once(spark):
    base = storage.new_path(spark, "e")
    make = lambda value: spark.createDataFrame([(1, 2, "2024-07-01", value, 1.0, 1.5)], (
        "store_id long, product_id long, dt string, actual double, prediction double, rolling_prediction double")).withColumn(
        "dt", F.col("dt").cast("date"))
    checks = lambda df: gates.finite_nonnegative(df, ["actual"])
    with pytest.raises(gates.GateFailure):
        tables.load_evaluation(spark, base, make(-1.0), checks)
    assert tables.stored_evaluation(spark, base).count() == 0
    assert tables.load_evaluation(spark, base, make(2.0), checks) == "load"
    assert tables.load_evaluation(spark, base, make(2.0), checks) == "keep"
    for other in (make(3.0), make(2.0).limit(0), make(2.0).unionByName(make(2.0))):
        with pytest.raises(tables.EvaluationChanged):
            tables.load_evaluation(spark, base, other, checks)
    stored = tables.stored_evaluation(spark, base).collect()
    assert [r["actual"] for r in stored] == [2.0] and stored[0]["source_print"]


def test_a_broken_layer_stops_the_warehouse(spark, sf_dir):
    base = storage.new_path(spark, "w")
    stage = storage.written(inputs.staging(spark, sf_dir), "staging")
    n = stage.count()
    expected = {"rows": n, "products": stage.select("product_id").distinct().count(),
                "stores": stage.select("store_id").distinct().count(), "dates": 97}
    built = warehouse.build(spark, base, stage, expected)
    stored = {k: built.read(k, s) for k, s in warehouse.LAYER_SCHEMAS.items()}
    seen = {k: {name: stored[k].count()} for k, name in warehouse.LAYERS.items()}
    failing = lambda t, see=seen, want=expected: {r["check"] for r in warehouse.stored_gates(t, see, want).filter("not ok").collect()}
    assert failing(stored) == set()
    lost = stored | {"dim_product": stored["dim_product"].filter("product_id <> 3"), "dim_date": stored["dim_date"].filter("day > 1")}
    assert failing(lost) == {"orphan_products", "orphan_dates"}
    assert failing(stored | {"fact": stored["fact"].unionByName(stored["fact"].limit(1))}) == {"duplicate_business_keys"}
    moved = F.when(F.col("dt") == "2024-04-01", F.col("city_id") + 1).otherwise(F.col("city_id"))
    assert failing(stored | {"staging": stage.withColumn("city_id", moved)}) == {"stores_with_two_cities"}
    assert failing(stored, seen | {"dim_store": {"store_rows": 1}}) == {"store_rows"}

    for bad, check in (
        (stage.withColumn("sale_amount", F.when(F.col("product_id") == 3, -1.0).otherwise(F.col("sale_amount"))), "sale_nonnegative"),
        (stage.withColumn("city_id", F.when(F.col("product_id") != 3, F.col("city_id"))), "null_values"),
        (stage.filter("product_id <> 3"), "product_rows"),
    ):
        with pytest.raises(gates.GateFailure, match=check):
            warehouse.build(spark, base, bad, expected)
    assert versions.snapshot(spark, base).number == built.number


def test_counts_come_from_footers(spark, tmp_path):
    path = f"{tmp_path}/raw"
    spark.range(100).withColumn("source_file", F.when(F.col("id") < 30, "a").otherwise("b")).write.partitionBy("source_file").parquet(path)
    counts = tables.footer_counts(spark, path, ["source_file"])
    assert {tuple(r) for r in counts.collect()} == {("a", 30), ("b", 70)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "id#" not in plan
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    assert tables.loaded_rows(spark, path, "a") == 30 and tables.loaded_rows(spark, path, "c") == 0
    assert tables.already_loaded(spark, path, "a", 30) and not tables.already_loaded(spark, path, "c", 30)
    with pytest.raises(tables.ShortLoad):
        tables.already_loaded(spark, path, "a", 31)
    assert {tuple(r) for r in tables.source_row_counts(spark, path).collect()} == {("a", 30, 2), ("b", 70, 2)}


def test_sketches_of_days_merge(spark):
    df = spark.range(60_000).select(
        F.lit("s").alias("source_file"), (F.col("id") % 7).alias("dt"), (F.col("id") * 31 % 40_009).alias("many"), (F.col("id") % 50).alias("few"))
    got = {r["column"]: r for r in profiling.cardinality_sketches(df, ["many", "few"], "source_file", "dt").collect()}
    assert got["many"]["distinct_values"] == 40_009 and got["few"]["distinct_values"] == 50
    assert all(r["within_2_percent"] and r["merged_as_one_pass"] for r in got.values())


def test_whole_numbers_become_integers(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (-3.0, "c")], "x double, y string")
    out = gates.as_integers(df, ["x"])
    assert out.schema["x"].dataType.simpleString() == "int" and [r["x"] for r in out.collect()] == [1, None, -3]
    for bad in (1.5, float("nan"), float("inf"), 1e12):
        with pytest.raises(gates.GateFailure):
            gates.as_integers(spark.createDataFrame([(bad,)], "x double"), ["x"])


def test_lineage_names_the_model(spark, sf_dir):
    sc, mart = chain.published(spark, sf_dir)
    right = ct.lineage_gate(mart.drop("prediction"), sc.forecast).first()
    assert right["joined_rows"] == right["lineage_rows"] == mart.count()
    other = ct.lineage_gate(mart.drop("prediction").withColumn("model_id", F.lit("another")), sc.forecast).first()
    assert other["lineage_rows"] == 0


def test_stored_evaluation_schema_holds_its_fields():
    assert [f.name for f in tables.STORED_EVALUATION][:-1] == [f.name for f in schemas.FORECAST_EVALUATION]

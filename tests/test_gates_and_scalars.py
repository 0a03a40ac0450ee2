import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfwise.functions import scalars as x
from shelfwise.operators import compare, gates
from shelfwise.plans import profiling, warehouse


def test_correlation_with_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    r = df.agg(x.guarded_corr(F.col("a"), F.col("b")).alias("ab"), x.guarded_corr(F.col("a"), F.col("c")).alias("ac")).first()
    assert r["ab"] == pytest.approx(0.9996, abs=1e-3) and r["ac"] is None


def test_right_closed_bands(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (0.51,), (2.0,), (9.0,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(x.right_closed_band(F.col("v"), [0, 0.5, 2], ["a", "b", "c", "d"])).collect()]
    assert got == ["a", "a", "b", "c", "c", "d", None, None]


def test_hash_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(200).withColumn("u", x.hash_uniform("s", F.col("id"), F.col("id")))
    a = {r["id"]: r["u"] for r in df.collect()}
    b = {r["id"]: r["u"] for r in df.repartition(7).collect()}
    assert a == b and all(0 <= v < 1 for v in a.values()) and len(set(a.values())) == 200


def test_rounding_is_exact_with_halves_away_from_zero(spark):
    df = spark.createDataFrame([(1.00499995,), (-0.125,), (0.125,), (-2.5,), (0.0,), (None,)], "v double")
    got = [r[0] for r in df.select(x.round_half_up(F.col("v"), 2)).collect()]
    assert got == [1.0, -0.13, 0.13, -2.5, 0.0, None]


def test_digests_tell_fields_and_nulls_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ("", "c")], "x string, y string")
    assert df.select(x.row_digest(F.col("x"), F.col("y"))).distinct().count() == 5


def test_null_is_not_finite_and_empty_tables_do_not_pass(spark):
    from shelfwise.operators import gates

    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (-1.0,)], "v double")
    assert gates.finite_nonnegative(df, ["v"]).first()["actual"] == 3
    assert not gates.row_count_gate(df.filter("false"), "rows", 0).first()["ok"]
    assert gates.row_count_gate(df, "rows", 4).first()["ok"]


def test_store_dimension_sentinel_and_city_gate(spark):
    stage = spark.createDataFrame([(1, 4, 2), (1, 4, 3), (2, 5, 7), (3, 5, 1), (3, 6, 1)],
                                  "store_id long, city_id long, management_group_id long")
    dim = {r["store_id"]: r["management_group_id"] for r in warehouse.dim_store(stage).collect()}
    assert dim == {1: -1, 2: 7, 3: 1}
    gate = gates.single_value_gate(stage, "store_id", "city_id", "cities").first()
    assert (gate["actual"], gate["ok"]) == (1, False)


def test_array_shapes_show_short_and_missing_arrays(spark):
    df = spark.createDataFrame([([0.0] * 24, [0] * 24), ([0.0] * 23, None)],
                               "hours_sale array<double>, hours_stock_status array<int>")
    got = {(r["column"], r["length"]): r["rows"] for r in profiling.array_shapes(df).collect()}
    assert got == {("hours_sale", 24): 1, ("hours_sale", 23): 1, ("hours_stock_status", 24): 1,
                   ("hours_stock_status", -1): 1}


def test_malformed_dates_are_counted_by_the_profile_and_refused_by_staging(spark):
    df = spark.createDataFrame([("2024-07-01",), ("soon",), ("2024-07-03",)], "dt string")
    r = profiling.date_profile(df, "dt").first()
    assert (r["invalid_dates"], r["unique_dates"], r["calendar_days"]) == (1, 2, 3)
    with pytest.raises(PySparkException):
        df.select(F.col("dt").cast("date")).collect()


def test_rules_tolerate_null_and_count_violations(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,), (2.5,)], "v double")
    got = {r["check"]: r["actual"] for r in gates.rule_violations(df, {"v": F.col("v") >= 0}).collect()}
    assert got == {"v": 1}
    assert gates.integral_or_null(df, ["v"]).first()["actual"] == 1
    assert gates.null_counts(df, ["v"]).first()["actual"] == 1
    assert gates.finite_nonnegative(spark.createDataFrame([(float("inf"),), (float("nan"),), (-1.0,), (1.0,)], "v double"),
                                    ["v"]).first()["actual"] == 3


def test_orphans_and_duplicates(spark):
    fact = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k long")
    dim = spark.createDataFrame([(2,), (3,)], "k long")
    assert gates.foreign_key_gate(fact, dim, ["k"], "orphans").first()["actual"] == 2
    assert gates.unique_key_gate(fact, ["k"], "dup").first()["actual"] == 1


def test_bag_difference_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(1,), (2,), (4,), (None,)], "k long")
    got = {(r["k"], r["side"]): r["copies"] for r in compare.bag_difference(a, b, ["k"]).collect()}
    assert got == {(1, "left_only"): 2, (4, "right_only"): 1}


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).select(F.lit("s").alias("source_file"), F.col("id"))
    one = compare.table_fingerprint(df, ["source_file"], [F.col("id")])
    two = compare.table_fingerprint(df.orderBy(F.desc("id")).repartition(5), ["source_file"], [F.col("id")])
    other = compare.table_fingerprint(df.withColumn("id", F.col("id") + 1), ["source_file"], [F.col("id")])
    assert compare.registry_changes(one, two).first()["status"] == "unchanged"
    assert compare.registry_changes(one, other).first()["status"] == "changed"
    assert compare.registry_changes(one.filter("false"), other).first()["status"] == "new"


def test_wide_rows_are_compared_by_hash_first(spark):
    a = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [-0.0]), (None, [None])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0]), (None, [None]), (4, [])], "k int, v array<double>")
    for left, right in ((a, b), (b, a), (a, a)):
        want = compare.bag_difference(left, right, ["k", "v"])
        got = compare.wide_bag_difference(left, right, ["k", "v"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    hashed = compare.wide_bag_difference(a, b, ["k", "v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in hashed and compare.wide_bag_difference(a, b, ["k", "v"]).count() == 2

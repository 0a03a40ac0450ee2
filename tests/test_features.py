import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import gates
from shelfwise.plans import evaluation, features
from shelfwise.schemas import STAGING_RETAIL_DAILY

FIRST = date(2024, 6, 5)
AS_OF = "2024-07-02"


def ramp(spark, days=range(28), extra=()):
    """One series selling 1, 2, 3, ... ; ``extra`` adds (day offset, sale)."""
    rows = [(0, 1, 0, 3, 4, 5, 2, FIRST + timedelta(days=d), float(s), 0, 0.9, 0, 1, 0.0, 15.0, 50.0, 1.0,
             "train.parquet") for d, s in [*((d, d + 1) for d in days), *extra]]
    return spark.createDataFrame(rows, STAGING_RETAIL_DAILY)


def test_forward_features_of_a_ramp(spark):
    r = features.forward_features(ramp(spark, extra=[(28, 999999.0)]), AS_OF).first()
    assert (r["sales_lag_1"], r["sales_lag_7"]) == (28.0, 22.0)
    assert (r["sales_rolling_mean_7"], r["sales_rolling_mean_28"]) == (25.0, 14.5)
    assert r["sales_rolling_std_7"] == pytest.approx(statistics.stdev(range(22, 29)))
    assert r["sales_rolling_max_28"] == 28.0  # the later day is not read
    assert (r["day_of_week"], r["is_weekend"], r["discount"], r["activity_flag"]) == (3, 0, 0.9, 1)
    assert r["recent_growth_7_vs_28"] == 10.5


def test_history_gate(spark):
    gates.require(features.history_gate(ramp(spark), AS_OF))
    for bad in (ramp(spark, days=range(1, 28)), ramp(spark, extra=[(27, 28.0)]),
                ramp(spark, days=[*range(10), *range(11, 28)])):
        with pytest.raises(gates.GateFailure):
            gates.require(features.history_gate(bad, AS_OF))


def test_window_row_equals_forward_row(spark):
    worst = features.feature_parity(ramp(spark, extra=[(28, 5.0)]), AS_OF).agg(
        F.max("max_difference"), F.min("series")).first()
    assert worst[0] < 1e-9 and worst[1] == 1


def test_history_starts_empty_and_never_sees_the_target(spark):
    rows = features.features_v2(ramp(spark)).orderBy("dt").collect()
    assert rows[0]["sales_lag_1"] is None and rows[0]["history_count_28"] == 0
    assert rows[1]["sales_rolling_std_7"] is None  # one earlier row only
    assert rows[1]["sales_rolling_mean_7"] == 1.0
    assert rows[14]["sales_lag_14"] == 1.0 and rows[14]["sales_rolling_max_7"] == 14.0
    assert features.full_history(features.features_v2(ramp(spark))).count() == 0


def test_feature_sets_have_the_expected_sizes():
    assert {n: len(c) for n, c in features.FEATURE_SETS.items()} == {
        "V1": 16, "V2": 25, "V3C": 27, "V3W": 29, "V3": 31}


def test_wape_of_nothing_sold_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "a double, p double")
    r = df.agg(*evaluation.metrics(F.col("a"), F.col("p"))).first()
    assert (r["mae"], r["wape"]) == (1.5, None)


def test_training_gate_finds_bad_values(spark):
    good = features.training_frame(
        features.features_v3(ramp(spark, extra=[(d, float(d)) for d in range(28, 40)])), "2024-07-31")
    gates.require(features.training_gate(good))
    with pytest.raises(gates.GateFailure):
        gates.require(features.training_gate(good.withColumn("sales_lag_1", F.lit(float("nan")))))
    with pytest.raises(gates.GateFailure):
        gates.require(features.training_gate(good.withColumn("target_sale_amount", F.lit(-1.0))))

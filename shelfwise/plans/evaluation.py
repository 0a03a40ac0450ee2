"""Forecast error metrics and diagnostics over (actual, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import right_closed_band, share
from shelfwise.operators import gates
from shelfwise.plans import features
from shelfwise.schemas import DAILY_KEY

# Band edges and the labels users filter on.
DEMAND_EDGES = [0.0, 0.5, 1.0, 2.0]
DEMAND_LABELS = ["Zero", "0-0.5", "0.5-1.0", "1.0-2.0", ">2.0"]
STOCKOUT_EDGES = [0.0, 4.0, 8.0]
STOCKOUT_LABELS = ["No recent stockout", "0-4 hours", "4-8 hours", ">8 hours"]


def mae(a: Column, p: Column) -> Column:
    return F.avg(F.abs(a - p))


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(F.avg((a - p) * (a - p)))


def wape(a: Column, p: Column) -> Column:
    """Sum of absolute errors over total actual, NULL when nothing was sold."""
    return F.try_divide(F.sum(F.abs(a - p)), F.sum(F.abs(a)))


def metrics(a: Column, p: Column) -> list[Column]:
    return [mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), wape(a, p).alias("wape")]


def compare_predictions(rows: DataFrame, actual: str, models: dict[str, str]) -> DataFrame:
    """MAE, RMSE and WAPE per named prediction column, best MAE first.

    Predictions are unpivoted in the row, so the rows are read once.
    """
    a = F.col(actual)
    pairs = F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("prediction")) for n, c in models.items()
    ])
    long = rows.select(a.alias("actual"), F.inline(pairs)).filter("prediction IS NOT NULL")
    return (
        long.groupBy("model")
        .agg(F.count(F.lit(1)).alias("rows"), *metrics(F.col("actual"), F.col("prediction")))
        .orderBy("mae", "model")
    )


def holdout_rows(v2: DataFrame) -> DataFrame:
    return features.split(features.full_history(v2), "holdout")


def baseline_metrics(v2: DataFrame) -> DataFrame:
    """Naive baselines on the holdout."""
    return compare_predictions(
        holdout_rows(v2), "target_sale_amount",
        {"lag_1": "sales_lag_1", "lag_7": "sales_lag_7", "rolling_mean_7": "sales_rolling_mean_7"},
    )


def rolling_evaluation(v2: DataFrame) -> DataFrame:
    """Evaluation rows with the rolling mean standing in for the model."""
    rolling = F.col("sales_rolling_mean_7")
    return holdout_rows(v2).select(
        *DAILY_KEY, F.col("target_sale_amount").alias("actual"),
        rolling.alias("prediction"), rolling.alias("rolling_prediction"),
    )


def error_rows(rows: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Signed (positive = over-forecast) and absolute error per row."""
    signed = F.col(prediction) - F.col(actual)
    return rows.withColumns({
        "actual": F.col(actual), "prediction": F.col(prediction),
        "signed_error": signed, "absolute_error": F.abs(signed),
    })


def forecast_direction(errors: DataFrame) -> DataFrame:
    e = F.col("signed_error")
    return errors.agg(
        share(e < 0).alias("underforecast_rate"),
        share(e > 0).alias("overforecast_rate"),
        share(e == 0).alias("exact_rate"),
    )


def error_by(errors: DataFrame, group: Column, name: str) -> DataFrame:
    return errors.groupBy(group.alias(name)).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("actual").alias("actual_mean"),
        F.avg("absolute_error").alias("mae"),
    )


def error_by_weekend(errors: DataFrame) -> DataFrame:
    return error_by(errors, F.col("is_weekend"), "is_weekend")


def error_by_demand_band(errors: DataFrame) -> DataFrame:
    return error_by(errors, right_closed_band(F.col("actual"), DEMAND_EDGES, DEMAND_LABELS), "demand_band")


def error_by_stockout_band(errors: DataFrame) -> DataFrame:
    band = right_closed_band(F.col("stockout_rolling_mean_7"), STOCKOUT_EDGES, STOCKOUT_LABELS)
    return error_by(errors, band, "stockout_band")


def evaluation_gate(evaluation: DataFrame, rows: int, first: str, last: str) -> DataFrame:
    """Grain, count, nulls, dates and values of an evaluation table before import."""
    values = ["actual", "prediction", "rolling_prediction"]
    in_range = F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return gates.all_of([
        gates.row_count_gate(evaluation, "rows", rows),
        gates.unique_key_gate(evaluation, DAILY_KEY, "duplicate_keys"),
        gates.unpivot_counts(gates.null_counts(evaluation, evaluation.columns).agg(
            F.sum("actual").alias("null_values"))),
        gates.rule_violations(evaluation, {"dates_in_range": in_range}),
        gates.finite_nonnegative(evaluation, values),
    ])


def actual_mismatch(evaluation: DataFrame, fact: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Evaluation rows missing from the fact or disagreeing with it."""
    observed = fact.select(*DAILY_KEY, "sale_amount")
    joined = evaluation.join(observed, DAILY_KEY, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("sale_amount").isNull()).alias("missing"),
        F.count_if(F.abs(F.col("actual") - F.col("sale_amount")) > tolerance).alias("different"),
    )

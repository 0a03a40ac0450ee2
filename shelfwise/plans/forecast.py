"""Next-day forecasts: the rolling-mean model and boosted trees on MLlib."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import round_half_up
from shelfwise.plans.features import in_period
from shelfwise.schemas import SERIES_KEY

ROLLING_MODEL = "rolling_mean_7"


def forecast_rows(scored: DataFrame, as_of: str, run_id: str, model_id: str, policy: str) -> DataFrame:
    """Forecast table rows from (store, product, prediction)."""
    cutoff = date.fromisoformat(as_of)
    return scored.select(
        *SERIES_KEY,
        F.lit(cutoff).cast("date").alias("as_of_date"),
        F.lit(cutoff + timedelta(days=1)).cast("date").alias("target_date"),
        F.greatest(F.col("prediction"), F.lit(0.0)).alias("prediction"),
        F.lit(model_id).alias("model_id"),
        F.lit(policy).alias("input_policy"),
        F.lit(run_id).alias("run_id"),
    )


def rolling_forecast(fact: DataFrame, as_of: str, run_id: str) -> DataFrame:
    """Mean of the last seven days as the next day's demand."""
    first = str(date.fromisoformat(as_of) - timedelta(days=6))
    mean = in_period(fact, first, as_of).groupBy(*SERIES_KEY).agg(
        round_half_up(F.avg("sale_amount"), 6).alias("prediction")
    )
    return forecast_rows(mean, as_of, run_id, ROLLING_MODEL, "one_day_level_for_inventory")

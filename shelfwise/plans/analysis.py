"""Descriptive demand, stockout, commercial and weather analysis of the fact.

Every function takes fact rows (normally the training slice) and returns one
small result; all of them aggregate partially before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import (
    coefficient_of_variation,
    guarded_corr,
    round_half_up,
    share,
    week_start,
)
from shelfwise.operators.ordered import exact_percentiles, value_counts, with_grand_total
from shelfwise.sources.storage import written


def count_rows() -> Column:
    return F.count(F.lit(1))


def sale() -> Column:
    return F.col("sale_amount")


def out_hours() -> Column:
    return F.col("stockout_hours")


def r4(c: Column) -> Column:
    return round_half_up(c, 4)


def percent(cond: Column) -> Column:
    return round_half_up(share(cond) * 100, 2)


def five_stockout_bands() -> Column:
    return (
        F.when(out_hours() == 0, "No stockout")
        .when(out_hours().between(1, 4), "1-4 hours")
        .when(out_hours().between(5, 8), "5-8 hours")
        .when(out_hours().between(9, 12), "9-12 hours")
        .when(out_hours().between(13, 16), "13-16 hours")
    )


def three_stockout_bands() -> Column:
    return F.when(out_hours() == 0, "No stockout").when(out_hours().between(1, 8), "1-8 hours").otherwise("9-16 hours")


# --- network level -----------------------------------------------------------

def network_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        count_rows().alias("observations"),
        F.countDistinct("product_id").alias("products"),
        F.countDistinct("store_id").alias("stores"),
        F.countDistinct("dt").alias("dates"),
        F.sum(sale()).alias("total_sales"),
        F.avg(sale()).alias("average_daily_sales"),
        F.avg(out_hours()).alias("average_stockout_hours"),
    )


def daily_network(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dt").agg(
        F.sum(sale()).alias("total_sales"),
        F.avg(sale()).alias("average_sales_per_series"),
        F.avg(out_hours()).alias("average_stockout_hours"),
    )


def trailing_network_mean(rows: DataFrame, days: int = 7) -> DataFrame:
    """Mean of the last ``days`` daily network totals, NULL until the window is full.

    A row frame over days is expressed as an equi-join of each day with the
    day numbers it feeds, so no single-task window is needed.
    """
    daily = rows.groupBy("dt").agg(F.sum(sale()).alias("total_sales"))
    fed = daily.select(
        F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("back"), "dt", "total_sales"
    ).select(F.date_add("dt", F.col("back")).alias("dt"), F.col("total_sales").alias("part"))
    means = fed.groupBy("dt").agg(F.when(count_rows() == days, F.avg("part")).alias("rolling_mean"))
    return daily.join(means, "dt", "left")


def weekend_split(rows: DataFrame, dates: DataFrame) -> DataFrame:
    return by_date_attribute(rows, dates, ["is_weekend"]).groupBy("is_weekend").agg(
        F.sum("n").alias("observations"),
        (F.sum("sales") / F.sum("n")).alias("average_sales"),
        (F.sum("out") / F.sum("n")).alias("average_stockout_hours"),
        F.sum("sales").alias("total_sales"),
    )


def by_date_attribute(rows: DataFrame, dates: DataFrame, attributes: list[str]) -> DataFrame:
    """Daily sums joined with the calendar: the fact is reduced to one row per day first."""
    daily = rows.groupBy("dt").agg(
        count_rows().alias("n"), F.sum(sale()).alias("sales"), F.sum(out_hours()).alias("out")
    )
    return daily.join(dates.select("dt", *attributes), "dt")


def percent_of_total(rows: DataFrame, key: str, k: int = 20) -> DataFrame:
    totals = rows.groupBy(key).agg(F.sum(sale()).alias("total_sales"))
    shared = with_grand_total(totals, {"grand_total": F.sum("total_sales")})
    return (
        shared.select(
            key, "total_sales",
            (F.try_divide("total_sales", "grand_total") * 100).alias("percentage_of_total_sales"),
        )
        .orderBy(F.desc_nulls_last("total_sales"), key)
        .limit(k)
    )


def stockout_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(
        count_rows().alias("observations"),
        F.count_if(out_hours() > 0).alias("observations_with_stockout"),
        percent(out_hours() > 0).alias("stockout_observation_rate"),
        F.avg(out_hours()).alias("average_stockout_hours"),
    )


def stockout_bands(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(five_stockout_bands().alias("stockout_band"))
        .agg(
            count_rows().alias("observations"), F.avg(sale()).alias("average_sales"),
            percent(sale() == 0).alias("zero_sales_rate"), F.min(out_hours()).alias("_from"),
        )
        .orderBy("_from").drop("_from")
    )


def stockout_conditions(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy(three_stockout_bands().alias("stockout_condition"))
        .agg(
            F.count_if(sale() == 0).alias("zero_sales_rows"), count_rows().alias("observations"),
            percent(sale() == 0).alias("zero_sales_rate"), F.min(out_hours()).alias("_from"),
        )
        .orderBy("_from").drop("_from")
    )


# --- series level ------------------------------------------------------------

def series_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_id", "product_id").agg(
        count_rows().alias("days_observed"),
        F.avg(sale()).alias("mean_daily_sales"),
        F.stddev_samp(sale()).alias("std_daily_sales"),
        F.count_if(sale() == 0).alias("zero_sales_days"),
        F.max(sale()).alias("max_daily_sales"),
    )


def series_metrics_summary(rows: DataFrame) -> DataFrame:
    return series_metrics(rows).agg(
        count_rows().alias("series_count"),
        F.avg("mean_daily_sales").alias("avg_series_mean_sales"),
        F.avg("std_daily_sales").alias("avg_series_std_sales"),
        F.avg(F.col("zero_sales_days") / F.col("days_observed")).alias("avg_zero_sales_fraction"),
        F.avg("max_daily_sales").alias("avg_series_max_sales"),
    )


def top_cv_series(rows: DataFrame, k: int = 20) -> DataFrame:
    cv = coefficient_of_variation(F.col("mean_daily_sales"), F.col("std_daily_sales"))
    return (
        series_metrics(rows)
        .select("store_id", "product_id", "mean_daily_sales", "std_daily_sales",
                round_half_up(cv, 6).alias("coefficient_of_variation"))
        .orderBy(F.desc_nulls_last("coefficient_of_variation"), "store_id", "product_id")
        .limit(k)
    )


def intermittency_bands(rows: DataFrame) -> DataFrame:
    zero = F.col("zero_sales_days")
    fraction = zero / F.col("days_observed")
    band = F.when(zero == 0, "0%")
    for edge, label in ((0.10, "0-10%"), (0.25, "10-25%"), (0.50, "25-50%")):
        band = band.when(fraction <= edge, label)
    return (
        series_metrics(rows)
        .select(band.otherwise(">50%").alias("zero_sales_band"), "mean_daily_sales",
                fraction.alias("zero_sales_fraction"))
        .groupBy("zero_sales_band")
        .agg(
            count_rows().alias("series_count"),
            F.avg("mean_daily_sales").alias("average_mean_sales"),
            F.avg("zero_sales_fraction").alias("average_zero_sales_fraction"),
        )
        .orderBy("average_zero_sales_fraction")
    )


# --- time --------------------------------------------------------------------

def weekly_trend(rows: DataFrame) -> DataFrame:
    return rows.groupBy(week_start(F.col("dt")).alias("week_start")).agg(
        F.sum(sale()).alias("total_sales"),
        F.avg(sale()).alias("average_sales"),
        F.avg(out_hours()).alias("average_stockout_hours"),
    )


def weekday_profile(rows: DataFrame, dates: DataFrame) -> DataFrame:
    return (
        rows.join(dates.select("dt", "day_of_week", "day_name"), "dt")
        .groupBy("day_of_week", F.trim("day_name").alias("day_name"))
        .agg(
            F.avg(sale()).alias("average_sales"),
            F.stddev_samp(sale()).alias("sales_std"),
            F.avg(out_hours()).alias("average_stockout_hours"),
        )
    )


def weekend_uplift(rows: DataFrame, dates: DataFrame) -> DataFrame:
    split = (
        by_date_attribute(rows, dates, ["is_weekend"])
        .groupBy(week_start(F.col("dt")).alias("week_start"), "is_weekend")
        .agg((F.sum("sales") / F.sum("n")).alias("average_sales"))
    )
    wide = split.groupBy("week_start").agg(
        F.max(F.when(~F.col("is_weekend"), F.col("average_sales"))).alias("weekday_average"),
        F.max(F.when(F.col("is_weekend"), F.col("average_sales"))).alias("weekend_average"),
    )
    return wide.withColumn("weekend_uplift", F.col("weekend_average") - F.col("weekday_average"))


def period_compare(rows: DataFrame, first_until: str = "2024-04-26", last_from: str = "2024-05-27") -> DataFrame:
    dt = F.col("dt")
    period = (
        F.when(dt <= F.lit(first_until).cast("date"), "First 30 days")
        .when(dt >= F.lit(last_from).cast("date"), "Last 30 days")
        .otherwise("Middle period")
    )
    return rows.groupBy(period.alias("period")).agg(
        count_rows().alias("observations"), F.avg(sale()).alias("average_sales"), F.sum(sale()).alias("total_sales")
    )


# --- commercial --------------------------------------------------------------

def flag_effect(rows: DataFrame, flag: str) -> DataFrame:
    return rows.groupBy(flag).agg(
        count_rows().alias("observations"),
        r4(F.avg(sale())).alias("average_sales"),
        r4(F.stddev_samp(sale())).alias("sales_std"),
        r4(F.avg(out_hours())).alias("average_stockout_hours"),
    )


def activity_holiday_effect(rows: DataFrame) -> DataFrame:
    return rows.groupBy("activity_flag", "holiday_flag").agg(
        count_rows().alias("observations"),
        r4(F.avg(sale())).alias("average_sales"),
        r4(F.avg(out_hours())).alias("average_stockout_hours"),
        r4(F.avg("discount")).alias("average_discount"),
    )


QUARTILES = {"p25": 0.25, "median": 0.50, "p75": 0.75, "p95": 0.95}


def discount_distribution(rows: DataFrame) -> DataFrame:
    """Moments and exact percentiles from one table of value counts."""
    counts = value_counts(rows, ["discount"])
    n, v = F.col("n"), F.col("discount")
    known = F.sum(F.when(v.isNotNull(), n))
    basics = counts.agg(
        F.sum(n).alias("observations"),
        F.count(v).alias("unique_discount_values"),
        r4(F.min(v)).alias("minimum_discount"),
        r4(F.max(v)).alias("maximum_discount"),
        r4(F.try_divide(F.sum(v * n), known)).alias("average_discount"),
    )
    quantiles = exact_percentiles(counts, "discount", QUARTILES, weight="n")
    return basics.crossJoin(
        F.broadcast(quantiles.select(*[r4(F.col(c)).alias(c) for c in QUARTILES]))
    )


def discount_status(rows: DataFrame) -> DataFrame:
    status = F.when(F.col("discount") == 1, "No discount").otherwise("Discounted")
    return rows.groupBy(status.alias("discount_status")).agg(
        count_rows().alias("observations"),
        r4(F.avg("discount")).alias("average_discount_value"),
        r4(F.avg(sale())).alias("average_sales"),
        r4(F.stddev_samp(sale())).alias("sales_std"),
        r4(F.avg(out_hours())).alias("average_stockout_hours"),
    )


def exact_mean(name: str) -> Column:
    """Mean of a column of hundredths, summed as decimals: a tie in the last digit is one in any order of the rows."""
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double") / F.count(name)


def top_sales_days(rows: DataFrame, k: int = 15) -> DataFrame:
    return (
        rows.groupBy("dt")
        .agg(
            F.sum(sale()).alias("total"),
            r4(F.avg("activity_flag")).alias("activity_rate"),
            r4(F.avg("holiday_flag")).alias("holiday_rate"),
            r4(exact_mean("discount")).alias("average_discount"),
            r4(F.avg(out_hours())).alias("average_stockout_hours"),
        )
        .orderBy(F.desc("total"), "dt")
        .limit(k)
        .withColumn("total_sales", round_half_up(F.col("total"), 2))
        .drop("total")
    )


def event_days_summary(rows: DataFrame) -> DataFrame:
    return (
        rows.filter((F.col("activity_flag") == 1) | (F.col("holiday_flag") == 1))
        .groupBy("dt")
        .agg(
            r4(F.avg("activity_flag")).alias("activity_rate"),
            r4(F.avg("holiday_flag")).alias("holiday_rate"),
            r4(exact_mean("discount")).alias("average_discount"),
            r4(F.avg(sale())).alias("average_sales"),
        )
    )


# --- product -----------------------------------------------------------------

def product_metrics(rows: DataFrame) -> DataFrame:
    cv = F.try_divide(F.stddev_samp(sale()), F.avg(sale()))
    return rows.groupBy("product_id").agg(
        count_rows().alias("observations"),
        F.countDistinct("store_id").alias("stores"),
        F.avg(sale()).alias("mean_sales"),
        F.stddev_samp(sale()).alias("sales_std"),
        F.max(sale()).alias("max_sales"),
        share(sale() == 0).alias("zero_sales_fraction"),
        F.avg(out_hours()).alias("average_stockout_hours"),
        cv.alias("cv"),
    )


def product_profile(rows: DataFrame, k: int = 25) -> DataFrame:
    return (
        product_metrics(rows)
        .select(
            "product_id", "observations", "stores",
            r4(F.col("mean_sales")).alias("mean_sales"),
            r4(F.col("sales_std")).alias("sales_std"),
            r4(F.col("cv")).alias("coefficient_of_variation"),
            r4(F.col("max_sales")).alias("max_sales"),
            r4(F.col("zero_sales_fraction")).alias("zero_sales_fraction"),
            round_half_up(F.col("cv"), 6).alias("_cv"),
        )
        .orderBy(F.desc_nulls_last("_cv"), "product_id").limit(k).drop("_cv")
    )


def product_focus(rows: DataFrame, product_id: int) -> DataFrame:
    return product_metrics(rows.filter(F.col("product_id") == product_id)).select(
        "product_id", "stores", "observations",
        r4(F.col("mean_sales")).alias("average_sales"),
        r4(F.col("sales_std")).alias("sales_std"),
        r4(F.col("cv")).alias("coefficient_of_variation"),
        r4(F.col("average_stockout_hours")).alias("average_stockout_hours"),
        r4(F.col("zero_sales_fraction")).alias("zero_sales_fraction"),
    )


def product_by_store(rows: DataFrame, product_id: int, k: int = 25) -> DataFrame:
    cv = F.try_divide(F.stddev_samp(sale()), F.avg(sale()))
    return (
        rows.filter(F.col("product_id") == product_id)
        .groupBy("store_id")
        .agg(
            r4(F.avg(sale())).alias("average_sales"),
            r4(F.stddev_samp(sale())).alias("sales_std"),
            r4(cv).alias("coefficient_of_variation"),
            r4(F.avg(out_hours())).alias("average_stockout_hours"),
            round_half_up(cv, 6).alias("_cv"),
        )
        .orderBy(F.desc_nulls_last("_cv"), "store_id").limit(k).drop("_cv")
    )


def product_cv_distribution(rows: DataFrame) -> DataFrame:
    cv = F.try_divide(F.stddev_samp(sale()), F.avg(sale()))
    products = written(rows.groupBy("product_id").agg(cv.alias("cv")), "product_cv")
    means = products.agg(count_rows().alias("products"), r4(F.avg("cv")).alias("average_product_cv"))
    spread = exact_percentiles(products, "cv", {"median_product_cv": 0.50, "p95_product_cv": 0.95})
    return means.crossJoin(F.broadcast(
        spread.select(*[r4(F.col(c)).alias(c) for c in spread.columns])
    ))


# --- weather -----------------------------------------------------------------

WEATHER = {
    "precipitation": "precpt",
    "temperature": "avg_temperature",
    "humidity": "avg_humidity",
    "wind": "avg_wind_level",
}


def weather_ranges(rows: DataFrame) -> DataFrame:
    return rows.agg(*[
        round_half_up(agg(col), 2).alias(f"{prefix}_{name}")
        for name, col in WEATHER.items()
        for prefix, agg in (("min", F.min), ("max", F.max), ("avg", F.avg))
    ])


def weather_corr(rows: DataFrame) -> DataFrame:
    return rows.agg(*[
        r4(guarded_corr(sale(), F.col(col))).alias(f"sales_{name}_corr") for name, col in WEATHER.items()
    ])


def weather_corr_daily(rows: DataFrame) -> DataFrame:
    daily = rows.groupBy("dt").agg(
        F.avg(sale()).alias("sales"), *[F.avg(c).alias(n) for n, c in WEATHER.items()]
    )
    return daily.agg(*[
        r4(guarded_corr(F.col("sales"), F.col(n))).alias(f"daily_sales_{n}_corr") for n in WEATHER
    ])


def precipitation_bands(rows: DataFrame) -> DataFrame:
    rain = F.col("precpt")
    order = F.when(rain == 0, 1).when(rain <= 2, 2).when(rain <= 10, 3).otherwise(4)
    names = F.array(*[F.lit(x) for x in ("No precipitation", "Low", "Moderate", "High")])
    return (
        rows.groupBy(order.alias("band_order"))
        .agg(
            count_rows().alias("observations"),
            r4(F.avg(sale())).alias("average_sales"),
            r4(F.avg(out_hours())).alias("average_stockout_hours"),
        )
        .orderBy("band_order")
        .select(F.get(names, F.col("band_order") - 1).alias("precipitation_band"),
                "observations", "average_sales", "average_stockout_hours")
    )

"""Queries over layers stored in buckets of the series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans import features, scenario, warehouse
from shelfwise.registry import chain, inputs, query
from shelfwise.registry.oracle import oracle
from shelfwise.schemas import DAILY_KEY, SERIES_KEY
from shelfwise.sources import bucketed
from shelfwise.sources.storage import new_path, written


@dataclass
class Stored:
    fact: DataFrame
    profiles: DataFrame
    products: DataFrame
    dates: DataFrame


_STORED: dict[tuple, Stored] = {}


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    """Fact and series profiles in buckets, dimensions as they are; once per session and state of the input files."""
    key = (spark.sparkContext.applicationId, sf_dir, chain.input_files(spark, sf_dir))
    if key not in _STORED:
        stage = written(inputs.staging(spark, sf_dir), "staging")
        buckets = bucketed.buckets_for(bucketed.row_bytes(stage))
        places = new_path(spark, "fact"), new_path(spark, "profiles")
        bucketed.write(warehouse.fact(stage), places[0], SERIES_KEY, ["dt"], buckets)
        fact = bucketed.read(spark, places[0])
        profiles = scenario.series_profiles(fact.filter("source_file = 'train.parquet'"))
        bucketed.write(profiles, places[1], SERIES_KEY, buckets=buckets)
        # The calendar comes from one column of the stored fact, no second panel.
        _STORED[key] = Stored(fact, bucketed.read(spark, places[1]), written(warehouse.dim_product(stage), "dim_product"),
                              written(warehouse.calendar(fact), "dim_date"))
    return _STORED[key]


def _star(s, d):
    st = stored(s, d)
    return warehouse.star_join(st.fact, st.products, st.dates).select(
        *DAILY_KEY, "sale_amount", "first_category_id", "third_category_id", "day_name", "is_weekend")


query("stored_star_join", oracle("""
SELECT f.store_id, f.product_id, f.dt, f.sale_amount, p.first_category_id, p.third_category_id,
       strftime(f.dt, '%A') AS day_name, d.is_weekend
FROM fact f JOIN dim_product p ON p.product_id = f.product_id JOIN dim_date d ON d.dt = f.dt""", "sale_amount", "dt"))(_star)

query("stored_series_windows", oracle("""
SELECT store_id, product_id, dt, lag(sale_amount, 7) OVER w AS sales_lag_7,
       avg(sale_amount) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS sales_mean_14,
       max(stockout_hours) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS most_stockout_hours_7
FROM fact WINDOW w AS (PARTITION BY store_id, product_id ORDER BY dt)""", "sales_lag_7 sales_mean_14", "dt"))(
    lambda s, d: stored(s, d).fact.select(
        *DAILY_KEY, features.lag("sale_amount", 7).alias("sales_lag_7"),
        features.trailing(F.avg("sale_amount"), 14).alias("sales_mean_14"),
        features.trailing(F.max("stockout_hours"), 7).alias("most_stockout_hours_7")))


def _unusual(s, d):
    st = stored(s, d)
    far = F.abs(F.col("sale_amount") - F.col("mean_daily_demand")) > 2 * F.col("demand_std")
    return st.fact.join(st.profiles, SERIES_KEY).groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(far).alias("unusual_days"),
        F.max(F.when(far, F.col("dt"))).alias("last_unusual"))


query("stored_unusual_days", oracle("""
SELECT f.store_id, f.product_id, count(*) AS days,
       count(*) FILTER (WHERE abs(sale_amount - mean_daily_demand) > 2 * demand_std) AS unusual_days,
       max(dt) FILTER (WHERE abs(sale_amount - mean_daily_demand) > 2 * demand_std) AS last_unusual
FROM fact f JOIN profile p ON p.store_id = f.store_id AND p.product_id = f.product_id GROUP BY 1, 2""", "", "last_unusual"))(
    _unusual)

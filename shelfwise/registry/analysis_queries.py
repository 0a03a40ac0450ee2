"""Descriptive analysis queries."""

from __future__ import annotations

from shelfwise.operators import ordered
from shelfwise.plans import analysis as a
from shelfwise.plans import warehouse
from shelfwise.registry import inputs, query
from shelfwise.registry.oracle import oracle, rounded
from shelfwise.sources.storage import written

FOCUS_PRODUCT = 7


def r4(expr: str) -> str:
    return rounded(expr, 4)


def r2(expr: str) -> str:
    return rounded(expr, 2)


def _dates(spark, sf_dir):
    """The calendar as a written table, so joins see its real size."""
    return written(warehouse.dim_date(inputs.staging(spark, sf_dir)), "dim_date")


ZERO_RATE = r2("100e0 * count(*) FILTER (WHERE sale_amount = 0) / count(*)")

query("network_summary", oracle("""
SELECT count(*) AS observations, count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores,
       count(DISTINCT dt) AS dates, sum(sale_amount) AS total_sales, avg(sale_amount) AS average_daily_sales,
       avg(stockout_hours) AS average_stockout_hours FROM train""",
    "total_sales average_daily_sales average_stockout_hours"))(
    lambda s, d: a.network_summary(inputs.train(s, d)))

query("daily_network", oracle("""
SELECT dt, sum(sale_amount) AS total_sales, avg(sale_amount) AS average_sales_per_series,
       avg(stockout_hours) AS average_stockout_hours FROM train GROUP BY dt""",
    "total_sales average_sales_per_series average_stockout_hours", "dt"))(
    lambda s, d: a.daily_network(inputs.train(s, d)))

query("trailing_calendar_mean", oracle("""
SELECT dt, total_sales,
       CASE WHEN count(*) OVER w = 7 THEN avg(total_sales) OVER w END AS rolling_mean
FROM (SELECT dt, sum(sale_amount) AS total_sales FROM train GROUP BY dt)
WINDOW w AS (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", "total_sales rolling_mean", "dt"))(
    lambda s, d: a.trailing_network_mean(inputs.train(s, d)))

query("weekend_split", oracle("""
SELECT d.is_weekend, count(*) AS observations, avg(f.sale_amount) AS average_sales,
       avg(f.stockout_hours) AS average_stockout_hours, sum(f.sale_amount) AS total_sales
FROM train f JOIN dim_date d ON f.dt = d.dt GROUP BY d.is_weekend""",
    "average_sales average_stockout_hours total_sales"))(
    lambda s, d: a.weekend_split(inputs.train(s, d), _dates(s, d)))

query("fact_date_join_agg", oracle("""
SELECT d.day_of_week, d.is_weekend, count(*) AS observations, sum(f.sale_amount) AS total_sales,
       CAST(sum(f.stockout_hours) AS BIGINT) AS stockout_hours
FROM train f JOIN dim_date d ON f.dt = d.dt GROUP BY d.day_of_week, d.is_weekend""", "total_sales"))(
    lambda s, d: a.by_date_attribute(inputs.train(s, d), _dates(s, d), ["day_of_week", "is_weekend"])
    .groupBy("day_of_week", "is_weekend")
    .agg({"n": "sum", "sales": "sum", "out": "sum"})
    .withColumnsRenamed({"sum(n)": "observations", "sum(sales)": "total_sales", "sum(out)": "stockout_hours"}))

for _key in ("product_id", "store_id"):
    _name = "percent_of_total" if _key == "product_id" else "percent_of_total_store"
    query(_name, oracle(f"""
SELECT {_key}, total_sales, total_sales / sum(total_sales) OVER () * 100 AS percentage_of_total_sales
FROM (SELECT {_key}, sum(sale_amount) AS total_sales FROM train GROUP BY {_key})
ORDER BY total_sales DESC, {_key} LIMIT 20""", "total_sales percentage_of_total_sales"))(
        lambda s, d, key=_key: a.percent_of_total(inputs.train(s, d), key))

query("stockout_rate", oracle(f"""
SELECT count(*) AS observations, count(*) FILTER (WHERE stockout_hours > 0) AS observations_with_stockout,
       {r2("100e0 * count(*) FILTER (WHERE stockout_hours > 0) / count(*)")} AS stockout_observation_rate,
       avg(stockout_hours) AS average_stockout_hours FROM train""", "average_stockout_hours"))(
    lambda s, d: a.stockout_rate(inputs.train(s, d)))

query("stockout_bands", oracle(f"""
SELECT CASE WHEN stockout_hours = 0 THEN 'No stockout' WHEN stockout_hours <= 4 THEN '1-4 hours'
            WHEN stockout_hours <= 8 THEN '5-8 hours' WHEN stockout_hours <= 12 THEN '9-12 hours'
            WHEN stockout_hours <= 16 THEN '13-16 hours' END AS stockout_band,
       count(*) AS observations, avg(sale_amount) AS average_sales, {ZERO_RATE} AS zero_sales_rate
FROM train GROUP BY 1""", "average_sales"))(
    lambda s, d: a.stockout_bands(inputs.train(s, d)))

query("stockout_conditions", oracle(f"""
SELECT CASE WHEN stockout_hours = 0 THEN 'No stockout' WHEN stockout_hours BETWEEN 1 AND 8 THEN '1-8 hours'
            ELSE '9-16 hours' END AS stockout_condition,
       count(*) FILTER (WHERE sale_amount = 0) AS zero_sales_rows, count(*) AS observations,
       {ZERO_RATE} AS zero_sales_rate
FROM train GROUP BY 1"""))(
    lambda s, d: a.stockout_conditions(inputs.train(s, d)))

SERIES = """(SELECT store_id, product_id, count(*) AS days_observed, avg(sale_amount) AS mean_daily_sales,
       stddev_samp(sale_amount) AS std_daily_sales, count(*) FILTER (WHERE sale_amount = 0) AS zero_sales_days,
       max(sale_amount) AS max_daily_sales FROM train GROUP BY store_id, product_id)"""

query("series_metrics_summary", oracle(f"""
SELECT count(*) AS series_count, avg(mean_daily_sales) AS avg_series_mean_sales,
       avg(std_daily_sales) AS avg_series_std_sales,
       avg(CAST(zero_sales_days AS DOUBLE) / days_observed) AS avg_zero_sales_fraction,
       avg(max_daily_sales) AS avg_series_max_sales FROM {SERIES}""",
    "avg_series_mean_sales avg_series_std_sales avg_zero_sales_fraction avg_series_max_sales"))(
    lambda s, d: a.series_metrics_summary(inputs.train(s, d)))

TOP_CV = f"""
SELECT store_id, product_id, mean_daily_sales, std_daily_sales,
       CASE WHEN mean_daily_sales > 0 THEN {rounded("std_daily_sales / mean_daily_sales")} END AS coefficient_of_variation
FROM {SERIES} ORDER BY coefficient_of_variation DESC NULLS LAST, store_id, product_id"""
query("top_cv_series", oracle(TOP_CV + " LIMIT 20", "mean_daily_sales std_daily_sales"))(
    lambda s, d: a.top_cv_series(inputs.train(s, d)))
query("topk", oracle(TOP_CV + " LIMIT 25", "mean_daily_sales std_daily_sales"))(
    lambda s, d: a.top_cv_series(inputs.train(s, d), k=25))

query("intermittency_bands", oracle(f"""
SELECT CASE WHEN zero_sales_days = 0 THEN '0%'
            WHEN CAST(zero_sales_days AS DOUBLE) / days_observed <= 0.10e0 THEN '0-10%'
            WHEN CAST(zero_sales_days AS DOUBLE) / days_observed <= 0.25e0 THEN '10-25%'
            WHEN CAST(zero_sales_days AS DOUBLE) / days_observed <= 0.50e0 THEN '25-50%'
            ELSE '>50%' END AS zero_sales_band,
       count(*) AS series_count, avg(mean_daily_sales) AS average_mean_sales,
       avg(CAST(zero_sales_days AS DOUBLE) / days_observed) AS average_zero_sales_fraction
FROM {SERIES} GROUP BY 1""", "average_mean_sales average_zero_sales_fraction"))(
    lambda s, d: a.intermittency_bands(inputs.train(s, d)))

query("weekly_trend", oracle("""
SELECT CAST(date_trunc('week', dt) AS DATE) AS week_start, sum(sale_amount) AS total_sales,
       avg(sale_amount) AS average_sales, avg(stockout_hours) AS average_stockout_hours
FROM train GROUP BY 1""", "total_sales average_sales average_stockout_hours", "week_start"))(
    lambda s, d: a.weekly_trend(inputs.train(s, d)))

query("weekday_profile", oracle("""
SELECT d.day_of_week, trim(d.day_name) AS day_name, avg(f.sale_amount) AS average_sales,
       stddev_samp(f.sale_amount) AS sales_std, avg(f.stockout_hours) AS average_stockout_hours
FROM train f JOIN dim_date d ON f.dt = d.dt GROUP BY 1, 2""",
    "average_sales sales_std average_stockout_hours"))(
    lambda s, d: a.weekday_profile(inputs.train(s, d), _dates(s, d)))

query("weekend_uplift_pivot", oracle("""
SELECT week_start, max(v) FILTER (WHERE NOT is_weekend) AS weekday_average,
       max(v) FILTER (WHERE is_weekend) AS weekend_average,
       max(v) FILTER (WHERE is_weekend) - max(v) FILTER (WHERE NOT is_weekend) AS weekend_uplift
FROM (SELECT CAST(date_trunc('week', f.dt) AS DATE) AS week_start, d.is_weekend, avg(f.sale_amount) AS v
      FROM train f JOIN dim_date d ON f.dt = d.dt GROUP BY 1, 2) GROUP BY week_start""",
    "weekday_average weekend_average weekend_uplift", "week_start"))(
    lambda s, d: a.weekend_uplift(inputs.train(s, d), _dates(s, d)))

query("period_compare", oracle("""
SELECT CASE WHEN dt <= DATE '2024-04-26' THEN 'First 30 days' WHEN dt >= DATE '2024-05-27' THEN 'Last 30 days'
            ELSE 'Middle period' END AS period,
       count(*) AS observations, avg(sale_amount) AS average_sales, sum(sale_amount) AS total_sales
FROM train GROUP BY 1""", "average_sales total_sales"))(
    lambda s, d: a.period_compare(inputs.train(s, d)))

query("custom_order", oracle("""
SELECT period, observations, sort_key FROM (
  SELECT CASE WHEN dt <= DATE '2024-04-26' THEN 'First 30 days' WHEN dt >= DATE '2024-05-27' THEN 'Last 30 days'
              ELSE 'Middle period' END AS period, count(*) AS observations,
         CASE min(CASE WHEN dt <= DATE '2024-04-26' THEN 1 WHEN dt >= DATE '2024-05-27' THEN 3 ELSE 2 END)
              WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS sort_key
  FROM train GROUP BY 1) ORDER BY sort_key"""))(
    lambda s, d: a.period_compare(inputs.train(s, d)).selectExpr(
        "period", "observations",
        "CASE period WHEN 'First 30 days' THEN 1 WHEN 'Middle period' THEN 2 ELSE 3 END AS sort_key",
    ).orderBy("sort_key"))

for _flag in ("activity", "holiday"):
    query(f"{_flag}_effect", oracle(f"""
SELECT {_flag}_flag, count(*) AS observations, {r4("avg(sale_amount)")} AS average_sales,
       {r4("stddev_samp(sale_amount)")} AS sales_std, {r4("avg(stockout_hours)")} AS average_stockout_hours
FROM train GROUP BY 1"""))(
        lambda s, d, flag=_flag: a.flag_effect(inputs.train(s, d), f"{flag}_flag"))

query("activity_holiday_effect", oracle(f"""
SELECT activity_flag, holiday_flag, count(*) AS observations, {r4("avg(sale_amount)")} AS average_sales,
       {r4("avg(stockout_hours)")} AS average_stockout_hours, {r4("avg(discount)")} AS average_discount
FROM train GROUP BY 1, 2"""))(
    lambda s, d: a.activity_holiday_effect(inputs.train(s, d)))

query("discount_distribution", oracle(f"""
SELECT count(*) AS observations, count(DISTINCT discount) AS unique_discount_values,
       {r4("min(discount)")} AS minimum_discount, {r4("max(discount)")} AS maximum_discount,
       {r4("avg(discount)")} AS average_discount, {r4("quantile_cont(discount, 0.25)")} AS p25,
       {r4("quantile_cont(discount, 0.5)")} AS median, {r4("quantile_cont(discount, 0.75)")} AS p75,
       {r4("quantile_cont(discount, 0.95)")} AS p95 FROM train"""))(
    lambda s, d: a.discount_distribution(inputs.train(s, d)))

query("discount_status", oracle(f"""
SELECT CASE WHEN discount = 1 THEN 'No discount' ELSE 'Discounted' END AS discount_status,
       count(*) AS observations, {r4("avg(discount)")} AS average_discount_value,
       {r4("avg(sale_amount)")} AS average_sales, {r4("stddev_samp(sale_amount)")} AS sales_std,
       {r4("avg(stockout_hours)")} AS average_stockout_hours FROM train GROUP BY 1"""))(
    lambda s, d: a.discount_status(inputs.train(s, d)))

query("top_sales_days", oracle(f"""
SELECT dt, {r2("total")} AS total_sales, activity_rate, holiday_rate, average_discount, average_stockout_hours
FROM (SELECT dt, sum(sale_amount) AS total, {r4("avg(activity_flag)")} AS activity_rate,
             {r4("avg(holiday_flag)")} AS holiday_rate, {r4("CAST(sum(CAST(discount AS DECIMAL(18,2))) AS DOUBLE) / count(discount)")} AS average_discount,
             {r4("avg(stockout_hours)")} AS average_stockout_hours FROM train GROUP BY dt)
ORDER BY total DESC, dt LIMIT 15""", dates="dt"))(
    lambda s, d: a.top_sales_days(inputs.train(s, d)))

EVENT_DAYS = oracle(f"""
SELECT dt, {r4("avg(activity_flag)")} AS activity_rate, {r4("avg(holiday_flag)")} AS holiday_rate,
       {r4("CAST(sum(CAST(discount AS DECIMAL(18,2))) AS DOUBLE) / count(discount)")} AS average_discount,
       {r4("avg(sale_amount)")} AS average_sales
FROM train WHERE activity_flag = 1 OR holiday_flag = 1 GROUP BY dt""", dates="dt")
query("event_days_summary", EVENT_DAYS)(lambda s, d: a.event_days_summary(inputs.train(s, d)))

query("disjunctive_filter", oracle("""
SELECT activity_flag, holiday_flag, count(*) AS observations, sum(sale_amount) AS total_sales
FROM train WHERE activity_flag = 1 OR holiday_flag = 1 GROUP BY 1, 2""", "total_sales"))(
    lambda s, d: inputs.train(s, d).filter("activity_flag = 1 OR holiday_flag = 1")
    .groupBy("activity_flag", "holiday_flag")
    .agg(a.count_rows().alias("observations"), a.F.sum("sale_amount").alias("total_sales")))

PRODUCTS = """(SELECT product_id, count(*) AS observations, count(DISTINCT store_id) AS stores,
  avg(sale_amount) AS mean_sales, stddev_samp(sale_amount) AS std, max(sale_amount) AS top,
  count(*) FILTER (WHERE sale_amount = 0) / CAST(count(*) AS DOUBLE) AS zero,
  avg(stockout_hours) AS out_hours, stddev_samp(sale_amount) / nullif(avg(sale_amount), 0) AS cv
  FROM train GROUP BY product_id)"""

query("product_profile", oracle(f"""
SELECT product_id, observations, stores, {r4("m")} AS mean_sales, {r4("std")} AS sales_std,
       {r4("cv")} AS coefficient_of_variation, {r4("top")} AS max_sales, {r4("zero")} AS zero_sales_fraction
FROM (SELECT *, mean_sales AS m FROM {PRODUCTS}) ORDER BY {rounded("cv")} DESC NULLS LAST, product_id LIMIT 25"""))(
    lambda s, d: a.product_profile(inputs.train(s, d)))

query("product_focus", oracle(f"""
SELECT product_id, stores, observations, {r4("mean_sales")} AS average_sales, {r4("std")} AS sales_std,
       {r4("cv")} AS coefficient_of_variation, {r4("out_hours")} AS average_stockout_hours,
       {r4("zero")} AS zero_sales_fraction FROM {PRODUCTS} WHERE product_id = {FOCUS_PRODUCT}"""))(
    lambda s, d: a.product_focus(inputs.train(s, d), FOCUS_PRODUCT))

query("product_by_store", oracle(f"""
SELECT store_id, {r4("m")} AS average_sales, {r4("std")} AS sales_std, {r4("cv")} AS coefficient_of_variation,
       {r4("out_hours")} AS average_stockout_hours
FROM (SELECT store_id, avg(sale_amount) AS m, stddev_samp(sale_amount) AS std, avg(stockout_hours) AS out_hours,
             stddev_samp(sale_amount) / nullif(avg(sale_amount), 0) AS cv
      FROM train WHERE product_id = {FOCUS_PRODUCT} GROUP BY store_id)
ORDER BY {rounded("cv")} DESC NULLS LAST, store_id LIMIT 25"""))(
    lambda s, d: a.product_by_store(inputs.train(s, d), FOCUS_PRODUCT))

query("product_cv_distribution", oracle(f"""
SELECT count(*) AS products, {r4("avg(cv)")} AS average_product_cv,
       {r4("quantile_cont(cv, 0.5)")} AS median_product_cv, {r4("quantile_cont(cv, 0.95)")} AS p95_product_cv
FROM {PRODUCTS}"""))(
    lambda s, d: a.product_cv_distribution(inputs.train(s, d)))

query("weather_ranges", oracle("SELECT " + ", ".join(
    f"{r2(f'{g}({c})')} AS {g}_{n}" for n, c in a.WEATHER.items() for g in ("min", "max", "avg")
) + " FROM train"))(lambda s, d: a.weather_ranges(inputs.train(s, d)))


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN {r4(f'corr({x}, {y})')} END"


query("weather_corr", oracle("SELECT " + ", ".join(
    f"{_corr('sale_amount', c)} AS sales_{n}_corr" for n, c in a.WEATHER.items()) + " FROM train"))(
    lambda s, d: a.weather_corr(inputs.train(s, d)))

query("weather_corr_daily", oracle("SELECT " + ", ".join(
    f"{_corr('sales', n)} AS daily_sales_{n}_corr" for n in a.WEATHER) + " FROM (SELECT dt, avg(sale_amount) AS sales, "
    + ", ".join(f"avg({c}) AS {n}" for n, c in a.WEATHER.items()) + " FROM train GROUP BY dt)"))(
    lambda s, d: a.weather_corr_daily(inputs.train(s, d)))

query("precipitation_bands", oracle(f"""
SELECT CASE WHEN precpt = 0 THEN 'No precipitation' WHEN precpt <= 2 THEN 'Low' WHEN precpt <= 10 THEN 'Moderate'
            ELSE 'High' END AS precipitation_band, count(*) AS observations,
       {r4("avg(sale_amount)")} AS average_sales, {r4("avg(stockout_hours)")} AS average_stockout_hours
FROM train GROUP BY 1"""))(
    lambda s, d: a.precipitation_bands(inputs.train(s, d)))

KEY = ["store_id", "product_id"]


def _percent_ranks(s, d):
    """Volume and variability rank of every series, ties averaged."""
    series = a.series_metrics(inputs.train(s, d)).select(
        *KEY, "mean_daily_sales",
        a.round_half_up(a.coefficient_of_variation(
            a.F.col("mean_daily_sales"), a.F.col("std_daily_sales")), 6).alias("cv"))
    series = written(series, "series")
    ranked = ordered.average_percent_rank(series, "mean_daily_sales", KEY, "volume_rank")
    return ordered.average_percent_rank(written(ranked, "volume_ranked"), "cv", KEY, "variability_rank")


query("pct_rank_avg", oracle(f"""
SELECT store_id, product_id, mean_daily_sales, cv,
       (min(rv) OVER v + max(rv) OVER v) / 2e0 / count(*) OVER () AS volume_rank,
       (min(rc) OVER c + max(rc) OVER c) / 2e0 / count(cv) OVER () AS variability_rank
FROM (SELECT *, row_number() OVER (ORDER BY mean_daily_sales, store_id, product_id) AS rv,
             CASE WHEN cv IS NOT NULL THEN row_number() OVER (ORDER BY cv NULLS LAST, store_id, product_id) END AS rc
      FROM (SELECT *, CASE WHEN mean_daily_sales > 0 THEN {rounded('std_daily_sales / mean_daily_sales')} END AS cv
            FROM {SERIES}))
WINDOW v AS (PARTITION BY mean_daily_sales), c AS (PARTITION BY cv)""",
    "mean_daily_sales cv volume_rank variability_rank"))(_percent_ranks)

"""Shared DuckDB table expressions, and the wrapper that rounds their output."""

from __future__ import annotations

import re

# name -> SELECT text. A name may use earlier ones; only what a query needs is emitted.
TABLES: dict[str, str] = {}

TABLES["cells"] = """
SELECT l_suppkey // 5 AS store_id, l_partkey % 40 AS product_id,
       date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 97 AS day_idx,
       sum(l_quantity) / 16 AS sale_amount,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) // count(*) AS BIGINT) AS points
FROM lineitem GROUP BY 1, 2, 3"""

TABLES["raw_rows"] = """
SELECT s.store_id % 4 AS city_id, s.store_id,
       CASE WHEN s.store_id % 4 = 0 THEN s.store_id % 7 ELSE s.product_id % 3 END AS management_group_id,
       s.product_id % 5 AS first_category_id, s.product_id % 10 AS second_category_id,
       s.product_id % 20 AS third_category_id, s.product_id,
       DATE '2024-03-28' + CAST(d.day_idx AS INTEGER) AS dt, d.day_idx,
       coalesce(c.sale_amount, 0.0) AS sale_amount,
       CAST(greatest((s.store_id * 7 + s.product_id * 3 + d.day_idx * 5) % 30 - 13, 0) AS INTEGER) AS stock_hour6_22_cnt,
       (100 - coalesce(c.points, 0)) / 100e0 AS discount,
       CASE WHEN d.day_idx IN (7, 8, 34, 35, 36, 73) THEN 1 ELSE 0 END AS holiday_flag,
       CASE WHEN (s.product_id + d.day_idx) % 7 = 0 THEN 1 ELSE 0 END AS activity_flag,
       CAST(greatest((s.store_id % 4 * 13 + d.day_idx * 7) % 20 - 7, 0) AS DOUBLE) AS precpt,
       15e0 + (d.day_idx % 30) * 0.5e0 + s.store_id % 4 AS avg_temperature,
       50e0 + (d.day_idx * 11 + s.store_id % 4 * 5) % 40 AS avg_humidity,
       1e0 + ((d.day_idx * 3 + s.store_id % 4) % 4) * 0.5e0 AS avg_wind_level,
       CASE WHEN d.day_idx < 90 THEN 'train.parquet' ELSE 'eval.parquet' END AS source_file
FROM (SELECT DISTINCT store_id, product_id FROM cells) s
CROSS JOIN (SELECT range AS day_idx FROM range(97)) d
LEFT JOIN cells c ON c.store_id = s.store_id AND c.product_id = s.product_id AND c.day_idx = d.day_idx"""

TABLES["fact"] = """
SELECT store_id, product_id, dt, sale_amount, CAST(stock_hour6_22_cnt AS SMALLINT) AS stockout_hours, discount,
       CAST(holiday_flag AS SMALLINT) AS holiday_flag, CAST(activity_flag AS SMALLINT) AS activity_flag, precpt, avg_temperature, avg_humidity, avg_wind_level, source_file
FROM raw_rows"""
TABLES["train"] = "SELECT * FROM fact WHERE source_file = 'train.parquet'"

TABLES["hours"] = """
SELECT r.store_id, r.product_id, r.dt, CAST(h.h AS INTEGER) AS hour_of_day,
       coalesce(c.qty, 0.0) AS sale_amount,
       CASE WHEN h.h >= 22 - r.stock_hour6_22_cnt AND h.h < 22 THEN 1 ELSE 0 END AS stock_status,
       r.source_file, r.sale_amount AS day_sales, r.stock_hour6_22_cnt
FROM raw_rows r CROSS JOIN (SELECT range AS h FROM range(24)) h
LEFT JOIN (SELECT l_suppkey // 5 AS store_id, l_partkey % 40 AS product_id,
                  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 97 AS day_idx,
                  l_orderkey % 24 AS h, sum(l_quantity) / 16 AS qty
           FROM lineitem GROUP BY 1, 2, 3, 4) c
  ON c.store_id = r.store_id AND c.product_id = r.product_id AND c.day_idx = r.day_idx AND c.h = h.h"""

TABLES["dim_product"] = """
SELECT DISTINCT product_id, first_category_id, second_category_id, third_category_id FROM raw_rows"""
TABLES["dim_store"] = """
SELECT store_id, min(city_id) AS city_id,
       CASE WHEN count(DISTINCT management_group_id) = 1 THEN min(management_group_id) ELSE -1 END AS management_group_id
FROM raw_rows GROUP BY store_id"""
TABLES["dim_date"] = """
SELECT dt, CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month,
       CAST(day(dt) AS INTEGER) AS day, CAST(isodow(dt) AS INTEGER) AS day_of_week, dayname(dt) AS day_name,
       CAST(weekofyear(dt) AS INTEGER) AS week_of_year, isodow(dt) >= 6 AS is_weekend
FROM (SELECT DISTINCT dt FROM raw_rows)"""
TABLES["bridge"] = "SELECT DISTINCT store_id, management_group_id FROM raw_rows"

TABLES["features"] = """
SELECT store_id, product_id, dt, sale_amount AS target_sale_amount,
       first_category_id, second_category_id, third_category_id,
       CAST(isodow(dt) AS INTEGER) AS day_of_week, isodow(dt) >= 6 AS is_weekend,
       CAST(holiday_flag AS SMALLINT) AS holiday_flag,
       lag(sale_amount, 1) OVER w AS sales_lag_1, lag(sale_amount, 2) OVER w AS sales_lag_2,
       lag(sale_amount, 3) OVER w AS sales_lag_3, lag(sale_amount, 7) OVER w AS sales_lag_7,
       lag(sale_amount, 14) OVER w AS sales_lag_14,
       avg(sale_amount) OVER w7 AS sales_rolling_mean_7, avg(sale_amount) OVER w14 AS sales_rolling_mean_14,
       avg(sale_amount) OVER w28 AS sales_rolling_mean_28,
       stddev_samp(sale_amount) OVER w7 AS sales_rolling_std_7,
       stddev_samp(sale_amount) OVER w14 AS sales_rolling_std_14,
       stddev_samp(sale_amount) OVER w28 AS sales_rolling_std_28,
       max(sale_amount) OVER w7 AS sales_rolling_max_7, max(sale_amount) OVER w14 AS sales_rolling_max_14,
       max(sale_amount) OVER w28 AS sales_rolling_max_28,
       count(sale_amount) OVER w28 AS history_count_28,
       lag(CAST(stock_hour6_22_cnt AS SMALLINT), 1) OVER w AS stockout_lag_1,
       avg(stock_hour6_22_cnt) OVER w7 AS stockout_rolling_mean_7,
       avg(sale_amount) OVER w7 - avg(sale_amount) OVER w28 AS recent_growth_7_vs_28,
       discount, CAST(activity_flag AS SMALLINT) AS activity_flag, precpt, avg_temperature, avg_humidity,
       avg_wind_level, source_file
FROM raw_rows
WINDOW w AS (PARTITION BY store_id, product_id ORDER BY dt),
       w7 AS (PARTITION BY store_id, product_id ORDER BY dt ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w14 AS (PARTITION BY store_id, product_id ORDER BY dt ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
       w28 AS (PARTITION BY store_id, product_id ORDER BY dt ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"""

# Rolling-mean model on the complete-history holdout.
TABLES["evaluation"] = """
SELECT store_id, product_id, dt, target_sale_amount AS actual, sales_rolling_mean_7 AS prediction,
       sales_rolling_mean_7 AS rolling_prediction
FROM features WHERE history_count_28 = 28 AND dt BETWEEN DATE '2024-06-26' AND DATE '2024-07-02'"""


def rounded(expr: str, digits: int = 6) -> str:
    """Halves away from zero."""
    return f"(sign({expr}) * floor(abs({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def compared(expr: str) -> str:
    """Six digits for the comparison of two engines; ties may lie a few ulp to either side."""
    return f"floor(({expr}) * 1e6 + 0.50001e0) / 1e6"


def _needed(text: str) -> list[str]:
    """Tables reachable from ``text``; a table only refers to earlier ones."""
    words = set(re.findall(r"[a-z_0-9]+", text))
    found = []
    for name in reversed(TABLES):
        if name in words:
            found.append(name)
            words |= set(re.findall(r"[a-z_0-9]+", TABLES[name]))
    return found[::-1]


def oracle(body: str, doubles: str = "", dates: str = "", recursive: str = "") -> str:
    """``body`` with the tables it uses in front and its output rounded.

    ``doubles`` are rounded to 6 digits, ``dates`` cast to text.
    ``recursive`` holds extra recursive table expressions.
    """
    ctes = [f"{n} AS ({TABLES[n]})" for n in _needed(body + " " + recursive)]
    if recursive:
        ctes.append(recursive)
    replaced = [f'{compared(c)} AS {c}' for c in doubles.split()]
    replaced += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    star = "*" + (f" REPLACE ({', '.join(replaced)})" if replaced else "")
    head = "WITH RECURSIVE "
    prefix = head + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{prefix}SELECT {star} FROM ({body}) AS result"

"""Scalar function queries, run over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import scalars as x
from shelfwise.registry import inputs, query
from shelfwise.registry.oracle import oracle, rounded
from shelfwise.schemas import DAILY_KEY


def lines(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_SQL = ", ".join(_LINE)

query("scalar_casts", oracle(f"""
SELECT {_LINE_SQL}, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_linenumber AS SMALLINT) AS line_small,
       CAST(l_quantity AS INTEGER) AS quantity_int, CAST(l_orderkey AS VARCHAR) AS order_text,
       CAST(l_linenumber AS DOUBLE) AS line_double, TRY_CAST(l_returnflag AS INTEGER) AS flag_number
FROM lineitem""", "line_double", "ship_date"))(
    lambda s, d: lines(s, d).select(
        *_LINE, F.col("l_shipdate").cast("date").alias("ship_date"),
        F.col("l_linenumber").cast("short").alias("line_small"), F.col("l_quantity").cast("int").alias("quantity_int"),
        F.col("l_orderkey").cast("string").alias("order_text"), F.col("l_linenumber").cast("double").alias("line_double"),
        F.col("l_returnflag").try_cast("int").alias("flag_number")))

query("scalar_null_handling", oracle(f"""
SELECT {_LINE_SQL}, nullif(l_tax, 0) AS tax_or_null, coalesce(nullif(l_tax, 0), -1e0) AS tax_filled,
       greatest(nullif(l_tax, 0), l_discount) AS larger, least(nullif(l_tax, 0), l_discount) AS smaller
FROM lineitem""", "tax_or_null tax_filled larger smaller"))(
    lambda s, d: lines(s, d).withColumn("t", F.nullif("l_tax", F.lit(0.0))).select(
        *_LINE, F.col("t").alias("tax_or_null"), F.coalesce("t", F.lit(-1.0)).alias("tax_filled"),
        F.greatest("t", "l_discount").alias("larger"), F.least("t", "l_discount").alias("smaller")))

query("scalar_math", oracle(f"""
SELECT {_LINE_SQL}, sqrt(l_extendedprice) AS root, l_quantity * l_quantity AS squared,
       CAST(ceil(l_extendedprice / l_quantity) AS BIGINT) AS unit_up,
       CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS unit_down,
       {rounded('l_extendedprice * (1 - l_discount)', 2)} AS net, abs(l_discount - l_tax) AS gap,
       greatest(l_discount - l_tax, 0) AS clipped FROM lineitem""", "root squared net gap clipped"))(
    lambda s, d: lines(s, d).select(
        *_LINE, F.sqrt("l_extendedprice").alias("root"), (F.col("l_quantity") * F.col("l_quantity")).alias("squared"),
        F.ceil(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_up"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_down"),
        x.round_half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("net"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.greatest(F.col("l_discount") - F.col("l_tax"), F.lit(0.0)).alias("clipped")))

query("scalar_dates", oracle(f"""
SELECT {_LINE_SQL}, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m,
       CAST(day(l_shipdate) AS INTEGER) AS d, CAST(isodow(l_shipdate) AS INTEGER) AS iso_day,
       CAST(weekofyear(l_shipdate) AS INTEGER) AS iso_week, trim(dayname(l_shipdate)) AS day_name,
       CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, CAST(l_shipdate AS DATE) + 1 AS next_day,
       CAST(l_shipdate AS DATE) - 27 AS window_start FROM lineitem""", "", "week_start next_day window_start"))(
    lambda s, d: lines(s, d).withColumn("dt", F.col("l_shipdate").cast("date")).select(
        *_LINE, F.year("dt").alias("y"), F.month("dt").alias("m"), F.day("dt").alias("d"),
        x.iso_weekday(F.col("dt")).cast("int").alias("iso_day"), F.weekofyear("dt").alias("iso_week"),
        F.trim(F.date_format("dt", "EEEE")).alias("day_name"), x.week_start(F.col("dt")).alias("week_start"),
        F.date_add("dt", 1).alias("next_day"), F.date_sub("dt", 27).alias("window_start")))

query("scalar_strings", oracle("""
SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS segment, substr(c_mktsegment, 1, 4) AS prefix,
       c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, c_mktsegment <> 'BUILDING' AS other,
       'C' || c_custkey || ' / ' || c_mktsegment AS label, format('{:,}', c_custkey * 1000) AS shown FROM customer"""))(
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(
        "c_custkey", F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment"),
        F.substring("c_mktsegment", 1, 4).alias("prefix"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("listed"),
        (F.col("c_mktsegment") != "BUILDING").alias("other"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(" / "), "c_mktsegment").alias("label"),
        F.format_number(F.col("c_custkey") * 1000, 0).alias("shown")))

query("scalar_case_bands", oracle(f"""
SELECT {_LINE_SQL}, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS size,
       CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS return_state,
       l_quantity > 25 AND l_discount > 0.05 AS big_discounted FROM lineitem"""))(
    lambda s, d: lines(s, d).select(
        *_LINE, F.when(F.col("l_quantity").between(1, 10), "small").when(F.col("l_quantity") <= 30, "medium")
        .otherwise("large").alias("size"),
        F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted")
        .otherwise("none").alias("return_state"),
        ((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.05)).alias("big_discounted")))

query("scalar_arrays", oracle("""
SELECT store_id, product_id, dt, CAST(24 AS INTEGER) AS hours, max(sale_amount) FILTER (WHERE hour_of_day = 0) AS first_hour,
       sum(sale_amount) FILTER (WHERE hour_of_day BETWEEN 6 AND 21) AS open_sales,
       CAST(count(*) FILTER (WHERE stock_status = 1 AND hour_of_day BETWEEN 6 AND 21) AS INTEGER) AS open_out,
       CAST(count(DISTINCT stock_status) AS INTEGER) AS statuses, CAST(NULL AS DOUBLE) AS beyond
FROM hours GROUP BY store_id, product_id, dt""", "first_hour open_sales", "dt"))(
    lambda s, d: inputs.raw_hourly(s, d).select(
        "store_id", "product_id", "dt", F.size("hours_sale").alias("hours"),
        F.get("hours_sale", F.lit(0)).alias("first_hour"),
        F.aggregate(F.slice("hours_sale", 7, 16), F.lit(0.0), lambda a, v: a + v).alias("open_sales"),
        F.size(F.filter(F.slice("hours_stock_status", 7, 16), lambda v: v == 1)).alias("open_out"),
        F.size(F.array_distinct("hours_stock_status")).alias("statuses"),
        F.try_element_at("hours_sale", F.lit(25)).alias("beyond")))

query("scalar_json", oracle("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_int, json_extract_string(props, '$.absent') AS absent
FROM events""", "k"))(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.get_json_object("props", "$.k").cast("int").alias("k_int"),
        F.get_json_object("props", "$.absent").alias("absent")))

_DIGEST = "concat_ws('|', store_id, product_id, dt, CAST(round(sale_amount * 16) AS BIGINT), stockout_hours)"
query("scalar_hash", oracle(f"""
SELECT store_id, md5(min({_DIGEST})) AS row_md5, sha256(max({_DIGEST})) AS row_sha,
       CAST(CAST(sum(CAST(('0x' || substr(md5({_DIGEST}), 1, 12)) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS fingerprint
FROM fact GROUP BY store_id"""))(
    lambda s, d: (lambda t: t.groupBy("store_id").agg(
        F.md5(F.min("text")).alias("row_md5"), F.sha2(F.max("text"), 256).alias("row_sha"),
        F.sum(F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)")
        .cast("string").alias("fingerprint")))(
        inputs.fact(s, d).select("store_id", F.concat_ws(
            "|", "store_id", "product_id", F.col("dt").cast("string"),
            F.round(F.col("sale_amount") * 16).cast("bigint").cast("string"),
            F.col("stockout_hours").cast("string")).alias("text"))))

query("scalar_right_closed_bins", oracle(f"""
SELECT store_id, product_id, dt, CASE WHEN sale_amount <= 0 THEN 'Zero' WHEN sale_amount <= 0.5 THEN '0-0.5'
  WHEN sale_amount <= 1 THEN '0.5-1.0' WHEN sale_amount <= 2 THEN '1.0-2.0' ELSE '>2.0' END AS band FROM fact""", "", "dt"))(
    lambda s, d: inputs.fact(s, d).select(
        *DAILY_KEY, x.right_closed_band(F.col("sale_amount"), [0.0, 0.5, 1.0, 2.0],
                                        ["Zero", "0-0.5", "0.5-1.0", "1.0-2.0", ">2.0"]).alias("band")))

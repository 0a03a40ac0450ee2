"""The canonical daily store-product panel, folded from order lines.

One aggregation to cells, one regrouping by series that also fills the missing
days. The second shuffle leaves the rows hash-partitioned by (store, product),
which every series window reuses. The list built per series holds at most one
entry per calendar day, whatever the size of the input. Hours travel and are sorted
as narrow entries (hour, quantity), and become arrays of 24 in the row that leaves:
zeros hardly weigh in a compressed shuffle, but in memory they would be spilled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Calendar of the panel.
DAYS = 97
FIRST_DATE = "2024-03-28"
LAST_DATE = "2024-07-02"
TRAIN_DAYS = 90
HOLIDAY_DAYS = [7, 8, 34, 35, 36, 73]
FOLD_ORIGIN = "1995-01-01"
HOURS = 24


def _lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.expr("l_suppkey div 5").alias("store_id"),
        (F.col("l_partkey") % 40).alias("product_id"),
        F.pmod(
            F.datediff(F.col("l_shipdate").cast("date"), F.lit(FOLD_ORIGIN).cast("date")), F.lit(DAYS)
        ).alias("day_idx"),
        (F.col("l_orderkey") % HOURS).alias("hour"),
        "l_quantity",
        F.floor(F.col("l_discount") * 100 + 0.5).alias("discount_points"),
    )


def _cells(lines: DataFrame) -> DataFrame:
    return lines.groupBy("store_id", "product_id", "day_idx").agg(
        (F.sum("l_quantity") / 16).alias("sale_amount"),
        F.expr("sum(discount_points) div count(*)").alias("discount_points"),
    )


def _hourly_cells(lines: DataFrame) -> DataFrame:
    """Cells with their hours that have a line, at most 25; partitioned by series, so no cell moves again."""
    hours = lines.groupBy("store_id", "product_id", "day_idx", "hour").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("discount_points").alias("discount_points"),
        F.count(F.lit(1)).alias("lines"))
    return hours.repartition("store_id", "product_id").groupBy("store_id", "product_id", "day_idx").agg(
        (F.sum("quantity") / 16).alias("sale_amount"),
        F.expr("sum(discount_points) div sum(lines)").alias("discount_points"),
        F.collect_list(F.struct(F.col("hour").cast("int").alias("hour"), (F.col("quantity") / 16).alias("sale"))).alias("hours"),
    )


def _by_hour(hours: Column) -> Column:
    """An array of 24; an hour without a known quantity is 0, but null where all lines of the day are its own."""
    each = lambda sale: F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), sale)
    first = F.get(hours, F.lit(0))
    return (
        F.when(F.size(hours) == 0, F.array_repeat(F.lit(0.0), HOURS))
        .when(F.size(hours) == 1, each(lambda h: F.when(first["hour"] == h, first["sale"]).otherwise(F.lit(0.0))))
        .otherwise(each(lambda h: F.coalesce(F.get(F.filter(hours, lambda e: e["hour"] == h), F.lit(0))["sale"], F.lit(0.0))))
    )


def _filled(cells: DataFrame, hourly: bool) -> DataFrame:
    values = ["day_idx", "sale_amount", "discount_points"] + (["hours"] if hourly else [])

    def empty_day(day: Column) -> Column:
        fields = [day.alias("day_idx"), F.lit(0.0).alias("sale_amount"),
                  F.lit(0).cast("bigint").alias("discount_points")]
        if hourly:
            fields.append(F.array().cast("array<struct<hour:int,sale:double>>").alias("hours"))
        return F.struct(*fields)

    per_series = cells.groupBy("store_id", "product_id").agg(
        F.collect_list(F.struct(*values)).alias("days")
    )
    missing = F.array_except(
        F.sequence(F.lit(0), F.lit(DAYS - 1)), F.transform("days", lambda d: d["day_idx"])
    )
    days = per_series.select(
        "store_id", "product_id", F.inline(F.concat("days", F.transform(missing, empty_day)))
    )
    return days.withColumn("hours_sale", _by_hour(F.col("hours"))).drop("hours") if hourly else days


def source_rows(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """Rows as a source file holds them (``dt`` is text), plus ``source_file``.

    The two hourly arrays are built only when ``hourly`` is set.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = _lines(lineitem)
    p = _filled(_hourly_cells(lines) if hourly else _cells(lines), hourly)
    day, store, product = F.col("day_idx"), F.col("store_id"), F.col("product_id")
    city = store % 4
    out_hours = F.greatest((store * 7 + product * 3 + day * 5) % 30 - 13, F.lit(0)).cast("int")
    cols = [
        city.alias("city_id"),
        "store_id",
        F.when(city == 0, store % 7).otherwise(product % 3).alias("management_group_id"),
        (product % 5).alias("first_category_id"),
        (product % 10).alias("second_category_id"),
        (product % 20).alias("third_category_id"),
        "product_id",
        F.date_add(F.lit(FIRST_DATE).cast("date"), day).cast("string").alias("dt"),
        "sale_amount",
        out_hours.alias("stock_hour6_22_cnt"),
        ((100 - F.col("discount_points")) / F.lit(100.0)).alias("discount"),
        day.isin(HOLIDAY_DAYS).cast("int").alias("holiday_flag"),
        ((product + day) % 7 == 0).cast("int").alias("activity_flag"),
        F.greatest((city * 13 + day * 7) % 20 - 7, F.lit(0)).cast("double").alias("precpt"),
        (F.lit(15.0) + (day % 30) * 0.5 + city).alias("avg_temperature"),
        (F.lit(50.0) + (day * 11 + city * 5) % 40).alias("avg_humidity"),
        (F.lit(1.0) + ((day * 3 + city) % 4) * 0.5).alias("avg_wind_level"),
        F.when(day < TRAIN_DAYS, "train.parquet").otherwise("eval.parquet").alias("source_file"),
    ]
    if hourly:
        status = F.transform(
            F.sequence(F.lit(0), F.lit(HOURS - 1)),
            lambda h: ((h >= 22 - out_hours) & (h < 22)).cast("int"),
        )
        cols += ["hours_sale", status.alias("hours_stock_status")]
    return p.select(*cols)

"""Source profiling: completeness, cardinality, duplicates, dates, arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import right_closed_band, round_half_up, share
from shelfwise.operators.ordered import exact_percentiles, value_counts

# Counting hours of the day, [6, 22), as a 1-based slice.
OPEN_FROM, OPEN_HOURS = 7, 16
BANDS = ["No stockout", "1-4 hours", "5-8 hours", "9-12 hours", "13-16 hours"]


SKETCH_BITS = 14  # standard error 0.8 %


def day_sketches(rows: DataFrame, cols: Sequence[str], source: str, day: str) -> DataFrame:
    """One distinct-count sketch per source, day and column, as a table that later days are added to."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"s_{c}") for c in cols]
    return rows.groupBy(F.col(source).alias("source"), F.col(day).alias("day")).agg(*sketches)


def merged_sketches(sketches: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values per column of all days together, without reading a row again."""
    union = [F.hll_sketch_estimate(F.hll_union_agg(f"s_{c}")).alias(c) for c in cols]
    one = sketches.groupBy(*by).agg(*union)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("estimate")) for c in cols])
    return one.select(*by, F.inline(pairs))


def cardinality_sketches(rows: DataFrame, cols: Sequence[str], source: str, day: str) -> DataFrame:
    """Exact distinct values per source and column, next to what the merged sketches of its days say."""
    merged = merged_sketches(day_sketches(rows, cols, source, day), cols, ["source"])
    whole = merged_sketches(rows.groupBy(F.col(source).alias("source")).agg(*[
        F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)).alias(f"s_{c}") for c in cols]), cols, ["source"])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    exact = (
        rows.select(F.col(source).alias("source"), F.inline(pairs)).filter("value IS NOT NULL")
        .groupBy("source", "column", "value").agg(F.lit(1).alias("one"))
        .groupBy("source", "column").agg(F.count(F.lit(1)).alias("distinct_values"))
    )
    both = merged.join(whole.withColumnRenamed("estimate", "one_pass"), ["source", "column"]).join(exact, ["source", "column"])
    near = F.abs(F.col("estimate") - F.col("distinct_values")) <= 0.02 * F.col("distinct_values")
    return both.select(
        F.col("source").alias(source), "column", "distinct_values", near.alias("within_2_percent"),
        (F.col("estimate") == F.col("one_pass")).alias("merged_as_one_pass"))


def cardinality_profile(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column, NULL counted as a value.

    Each (column, value) pair collapses in the map-side aggregation, so a
    column's few values cross the network once and no row is multiplied in
    the shuffle.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    return (
        rows.select(F.inline(pairs))
        .groupBy("column", "value").agg(F.lit(1).alias("one"))
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    )


def duplicate_profile(rows: DataFrame, row_cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Surplus identical rows (arrays excluded) and rows sharing a business key.

    Identical rows share their key, so counting rows per (key, row) first and
    then per key gives both numbers from one shuffle of the rows.
    """
    per_row = rows.groupBy(*dict.fromkeys([*key, *row_cols])).agg(F.count(F.lit(1)).alias("n"))
    per_key = per_row.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("surplus")
    )
    return per_key.agg(
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("exact_duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_keys"),
    )


def grain_profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_id", "product_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("series"), F.sum("n").alias("rows")
    )


def date_profile(rows: DataFrame, column: str) -> DataFrame:
    """Text dates: unparsable ones counted, range, distinct days, calendar span."""
    parsed = rows.select(F.try_to_date(F.col(column), "yyyy-MM-dd").alias("d"))
    per_day = parsed.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("invalid_dates"),
        F.count("d").alias("unique_dates"),
        F.min("d").alias("first_date"),
        F.max("d").alias("last_date"),
        (F.datediff(F.max("d"), F.min("d")) + 1).alias("calendar_days"),
    )


def describe_sales(rows: DataFrame, column: str = "sale_amount") -> DataFrame:
    """Moments and quartiles from one table of value counts.

    The deviation takes a second look at the counts around the known mean.
    """
    counts = value_counts(rows, [column])
    v, n = F.col(column), F.col("n")
    known = F.sum(F.when(v.isNotNull(), n))
    basics = counts.agg(
        known.alias("count"),
        (F.sum(F.when(v == 0, n).otherwise(0)).cast("double") / F.sum(n) * 100).alias("zero_percentage"),
        F.coalesce(F.sum(F.when(v < 0, n)), F.lit(0)).alias("negative_rows"),
        F.try_divide(F.sum(v * n), known).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    off = v - F.col("mean")
    spread = counts.crossJoin(F.broadcast(basics.select("mean", "count"))).agg(
        F.sqrt(F.try_divide(F.sum(off * off * n), F.max("count") - 1)).alias("std")
    )
    quartiles = exact_percentiles(counts, column, {"p25": 0.25, "p50": 0.50, "p75": 0.75}, weight="n")
    return basics.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(quartiles))


def hourly_total() -> Column:
    return F.aggregate("hours_sale", F.lit(0.0), lambda acc, x: acc + x)


def hourly_consistency(raw: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    off = F.abs(F.col("sale_amount") - hourly_total()) > tolerance
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(off).alias("mismatches"),
        (share(off) * 100).alias("mismatch_percentage"),
    )


def largest_hourly_differences(raw: DataFrame, k: int = 10) -> DataFrame:
    gap = F.abs(F.col("sale_amount") - hourly_total())
    return (
        raw.select("store_id", "product_id", "dt", gap.alias("difference"))
        .orderBy(F.desc("difference"), "store_id", "product_id", "dt").limit(k)
    )


def array_shapes(raw: DataFrame) -> DataFrame:
    """Rows per array length, -1 for a NULL array."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.size(c), F.lit(-1)).alias("length"))
        for c in ("hours_sale", "hours_stock_status")
    ])
    return raw.select(F.inline(pairs)).groupBy("column", "length").agg(F.count(F.lit(1)).alias("rows"))


def category_consistency(rows: DataFrame) -> DataFrame:
    """Products mapped to more than one category combination."""
    per_product = (
        rows.groupBy("product_id", "first_category_id", "second_category_id", "third_category_id")
        .agg(F.lit(1).alias("one")).groupBy("product_id").agg(F.count(F.lit(1)).alias("combinations"))
    )
    return per_product.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("combinations") > 1).alias("inconsistent_products"),
    )


def stock_status_values(raw: DataFrame) -> DataFrame:
    """How often each hourly status value occurs."""
    return raw.select(F.explode("hours_stock_status").alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("hours")
    )


def stock_status_profile(raw: DataFrame) -> DataFrame:
    """Value counts of the daily stockout counter, with the statuses seen on those days.

    The per-row distinct list has at most one entry per status value.
    """
    statuses = F.explode(F.array_distinct("hours_stock_status")).alias("status")
    return (
        raw.select("stock_hour6_22_cnt", statuses)
        .groupBy("stock_hour6_22_cnt", "status").agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("stock_hour6_22_cnt", "status")
    )


def stock_count_relationship(raw: DataFrame) -> DataFrame:
    open_hours = F.slice("hours_stock_status", OPEN_FROM, OPEN_HOURS)
    ones = F.size(F.filter(open_hours, lambda x: x == 1)) == F.col("stock_hour6_22_cnt")
    zeros = F.size(F.filter(open_hours, lambda x: x == 0)) == F.col("stock_hour6_22_cnt")
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ones).alias("matches_ones"),
        (share(ones) * 100).alias("matches_ones_percentage"),
        F.count_if(zeros).alias("matches_zeros"),
        (share(zeros) * 100).alias("matches_zeros_percentage"),
    )


def severity_band() -> Column:
    band = right_closed_band(F.col("stock_hour6_22_cnt"), [0, 4, 8, 12], BANDS)
    return F.when(F.col("stock_hour6_22_cnt").between(0, 16), band)


def stockout_sales_profile(rows: DataFrame) -> DataFrame:
    """Sales by stockout severity with an exact median, from one table of value counts."""
    counts = value_counts(rows.select("stock_hour6_22_cnt", "sale_amount"), ["stock_hour6_22_cnt", "sale_amount"])
    banded = counts.withColumn("stockout_band", severity_band()).filter("stockout_band IS NOT NULL")
    n, y = F.col("n"), F.col("sale_amount")
    size = F.sum(n)
    basics = banded.groupBy("stockout_band").agg(
        size.alias("rows"),
        round_half_up(F.try_divide(F.sum(y * n), F.sum(F.when(y.isNotNull(), n))), 3).alias("average_sales"),
        round_half_up(F.sum(F.when(y == 0, n).otherwise(0)).cast("double") / size * 100, 3).alias("zero_sales_rate"),
        round_half_up(F.sum(F.col("stock_hour6_22_cnt") * n).cast("double") / size, 3)
        .alias("average_stockout_hours"),
    )
    medians = exact_percentiles(banded, "sale_amount", {"median": 0.5}, by=["stockout_band"], weight="n")
    return basics.join(
        medians.select("stockout_band", round_half_up(F.col("median"), 3).alias("median_sales")),
        "stockout_band",
    )

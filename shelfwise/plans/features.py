"""Leakage-safe history features per series, and their next-day counterpart.

Train and evaluation rows go through the windows together; slicing by period
or source happens afterwards. All windows share one partitioning and order, so
they run over one sort, and the panel's own partitioning needs no shuffle.
Frames count rows, which equals days because the panel has no gaps.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.scalars import is_finite, iso_weekday
from shelfwise.operators import gates
from shelfwise.schemas import DAILY_KEY, SERIES_KEY

IDS = ["store_id", "product_id", "first_category_id", "second_category_id", "third_category_id"]
CALENDAR = ["day_of_week", "is_weekend", "holiday_flag"]
V1_HISTORY = [
    "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_rolling_mean_7", "sales_rolling_mean_14",
    "sales_rolling_std_7", "stockout_lag_1", "stockout_rolling_mean_7",
]
V2_EXTRA = [
    "sales_lag_2", "sales_lag_3", "sales_rolling_mean_28", "sales_rolling_std_14",
    "sales_rolling_std_28", "sales_rolling_max_7", "sales_rolling_max_14", "sales_rolling_max_28",
    "recent_growth_7_vs_28",
]
COMMERCIAL = ["discount", "activity_flag"]
WEATHER = ["precpt", "avg_temperature", "avg_humidity", "avg_wind_level"]

FEATURE_SETS = {
    "V1": IDS + CALENDAR + V1_HISTORY,
    "V2": IDS + CALENDAR + V1_HISTORY + V2_EXTRA,
    "V3C": IDS + CALENDAR + V1_HISTORY + V2_EXTRA + COMMERCIAL,
    "V3W": IDS + CALENDAR + V1_HISTORY + V2_EXTRA + WEATHER,
    "V3": IDS + CALENDAR + V1_HISTORY + V2_EXTRA + COMMERCIAL + WEATHER,
}

FULL_HISTORY = 28
# Experiment periods.
SPLITS = {
    "dev_train": (None, "2024-06-11"),
    "validation": ("2024-06-12", "2024-06-25"),
    "holdout": ("2024-06-26", "2024-07-02"),
}

_series = lambda: Window.partitionBy(*SERIES_KEY).orderBy("dt")


def lag(column: str, days: int) -> Column:
    return F.lag(column, days).over(_series())


def trailing(agg: Column, days: int) -> Column:
    """``agg`` over the ``days`` rows before the current one."""
    return agg.over(_series().rowsBetween(-days, -1))


def base_rows(stage: DataFrame) -> DataFrame:
    """Target, ids and calendar of each staged row.

    Category ids travel with the row and calendar parts come from the date, so
    no dimension join and no self-join is needed later.
    """
    dt = F.col("dt")
    return stage.select(
        *DAILY_KEY,
        F.col("sale_amount").alias("target_sale_amount"),
        "first_category_id", "second_category_id", "third_category_id",
        iso_weekday(dt).cast("int").alias("day_of_week"),
        (iso_weekday(dt) >= 6).alias("is_weekend"),
        F.col("holiday_flag").cast("short").alias("holiday_flag"),
        F.col("stock_hour6_22_cnt").cast("short").alias("stockout_hours"),
        "discount",
        F.col("activity_flag").cast("short").alias("activity_flag"),
        *WEATHER,
        "source_file",
    )


def _history_columns(names: list[str]) -> dict[str, Column]:
    y = "target_sale_amount"
    made: dict[str, Column] = {}
    for n in (1, 2, 3, 7, 14):
        made[f"sales_lag_{n}"] = lag(y, n)
    for k in (7, 14, 28):
        made[f"sales_rolling_mean_{k}"] = trailing(F.avg(y), k)
        made[f"sales_rolling_std_{k}"] = trailing(F.stddev_samp(y), k)
        made[f"sales_rolling_max_{k}"] = trailing(F.max(y), k)
    made["history_count_28"] = trailing(F.count(y), 28)
    made["stockout_lag_1"] = lag("stockout_hours", 1)
    made["stockout_rolling_mean_7"] = trailing(F.avg("stockout_hours"), 7)
    return {n: made[n] for n in names}


def features_v1(stage: DataFrame) -> DataFrame:
    rows = base_rows(stage).withColumns(_history_columns(V1_HISTORY))
    return rows.select(*DAILY_KEY, "target_sale_amount", *IDS[2:], *CALENDAR, *V1_HISTORY, "source_file")


def _deep(stage: DataFrame) -> DataFrame:
    names = V1_HISTORY + [c for c in V2_EXTRA if c != "recent_growth_7_vs_28"] + ["history_count_28"]
    rows = base_rows(stage).withColumns(_history_columns(names))
    growth = F.col("sales_rolling_mean_7") - F.col("sales_rolling_mean_28")
    return rows.withColumn("recent_growth_7_vs_28", growth)


_V2_COLUMNS = [*DAILY_KEY, "target_sale_amount", *IDS[2:], *CALENDAR, *V1_HISTORY, *V2_EXTRA,
               "history_count_28", "source_file"]


def features_v2(stage: DataFrame) -> DataFrame:
    return _deep(stage).select(*_V2_COLUMNS)


def features_v3(stage: DataFrame) -> DataFrame:
    return _deep(stage).select(*_V2_COLUMNS, *COMMERCIAL, *WEATHER)


def with_exogenous(v2: DataFrame, fact: DataFrame) -> DataFrame:
    """Commercial and weather columns joined back from a fact on its daily key.

    For feature tables kept without them; :func:`features_v3` carries the
    columns along and needs no join.
    """
    return v2.join(fact.select(*DAILY_KEY, *COMMERCIAL, *WEATHER), DAILY_KEY)


def model_ready_v1(v1: DataFrame, source: str) -> DataFrame:
    return v1.filter(F.col("source_file") == source).dropna(subset=V1_HISTORY)


def full_history(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("history_count_28") == FULL_HISTORY)


def in_period(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    dt = F.col("dt")
    if start:
        rows = rows.filter(dt >= F.lit(start).cast("date"))
    if end:
        rows = rows.filter(dt <= F.lit(end).cast("date"))
    return rows


def split(rows: DataFrame, name: str) -> DataFrame:
    return in_period(rows, *SPLITS[name])


def split_label() -> Column:
    dt, label = F.col("dt"), F.lit(None).cast("string")
    for name, (start, end) in SPLITS.items():
        cond = dt <= F.lit(end).cast("date")
        if start:
            cond = cond & (dt >= F.lit(start).cast("date"))
        label = F.when(cond, name).otherwise(label)
    return label


def split_counts(v3: DataFrame) -> DataFrame:
    """Rows per split for the short (V1) and full (V2+) history rule, one pass."""
    ready = F.lit(True)
    for c in V1_HISTORY:
        ready = ready & F.col(c).isNotNull()
    return v3.groupBy(split_label().alias("split")).agg(
        F.count_if(ready).alias("v1_rows"),
        F.count_if(F.col("history_count_28") == FULL_HISTORY).alias("v2_rows"),
        F.min("dt").alias("first_date"),
        F.max("dt").alias("last_date"),
    )


def training_frame(v3: DataFrame, as_of: str, feature_set: str = "V3C") -> DataFrame:
    """Target and features with a complete history up to ``as_of``, booleans as 0/1."""
    rows = full_history(in_period(v3, None, as_of))
    cols = [F.col(c).cast("int").alias(c) if c == "is_weekend" else F.col(c)
            for c in FEATURE_SETS[feature_set]]
    return rows.select("dt", "target_sale_amount", *cols)


def training_gate(frame: DataFrame) -> DataFrame:
    """Non-finite inputs, and negative targets."""
    numeric = [c for c in frame.columns if c != "dt"]
    rules = {c: is_finite(F.col(c).cast("double")) for c in numeric}
    rules["target_nonnegative"] = F.col("target_sale_amount") >= 0
    return gates.rule_violations(frame, rules)


# --- next-day features -------------------------------------------------------

def _window_rows(stage: DataFrame, as_of: str) -> DataFrame:
    last = date.fromisoformat(as_of)
    return in_period(stage, str(last - timedelta(days=FULL_HISTORY - 1)), as_of)


def history_gate(stage: DataFrame, as_of: str) -> DataFrame:
    """Every series known at the cutoff has 28 distinct days in the window, no day twice."""
    known = in_period(stage, None, as_of)
    first = F.lit(str(date.fromisoformat(as_of) - timedelta(days=FULL_HISTORY - 1))).cast("date")
    inside = F.col("dt") >= first
    per_series = known.groupBy(*SERIES_KEY).agg(
        F.count_if(inside).alias("rows"),
        F.countDistinct(F.when(inside, F.col("dt"))).alias("days"),
    )
    return gates.unpivot_counts(per_series.agg(
        F.count_if(F.col("rows") > F.col("days")).alias("series_with_duplicate_days"),
        F.count_if(F.col("days") != FULL_HISTORY).alias("series_without_28_days"),
    ))


def forward_features(stage: DataFrame, as_of: str, holiday_flag: int = 0) -> DataFrame:
    """Feature row of ``as_of`` + 1 per series, from the 28 days ending at ``as_of``.

    One conditional aggregation per series: a lag is the value of one calendar
    day and a rolling frame is a date range, so neither window nor sort is
    needed. Discount and activity are carried forward from the cutoff. Run
    :func:`history_gate` first.
    """
    target = date.fromisoformat(as_of) + timedelta(days=1)
    dt, y, out = F.col("dt"), F.col("sale_amount"), F.col("stock_hour6_22_cnt")

    def on_day(c: Column, back: int) -> Column:
        return F.max(F.when(dt == F.lit(str(target - timedelta(days=back))).cast("date"), c))

    def since(c: Column, back: int) -> Column:
        return F.when(dt >= F.lit(str(target - timedelta(days=back))).cast("date"), c)

    made = {f"sales_lag_{n}": on_day(y, n) for n in (1, 2, 3, 7, 14)}
    for k in (7, 14, 28):
        made[f"sales_rolling_mean_{k}"] = F.avg(since(y, k))
        made[f"sales_rolling_std_{k}"] = F.stddev_samp(since(y, k))
        made[f"sales_rolling_max_{k}"] = F.max(since(y, k))
    made["stockout_lag_1"] = on_day(out, 1)
    made["stockout_rolling_mean_7"] = F.avg(since(out, 7))
    for c in (*IDS[2:], "discount", "activity_flag"):
        made[c] = on_day(F.col(c), 1)
    rows = _window_rows(stage, as_of).groupBy(*SERIES_KEY).agg(*[c.alias(n) for n, c in made.items()])
    weekday = target.isoweekday()
    rows = rows.withColumns({
        "recent_growth_7_vs_28": F.col("sales_rolling_mean_7") - F.col("sales_rolling_mean_28"),
        "day_of_week": F.lit(weekday),
        "is_weekend": F.lit(int(weekday >= 6)),
        "holiday_flag": F.lit(holiday_flag),
    })
    return rows.select(*FEATURE_SETS["V3C"])


def feature_parity(stage: DataFrame, as_of: str) -> DataFrame:
    """Largest difference, per feature, between the next-day row and the window row."""
    target = date.fromisoformat(as_of) + timedelta(days=1)
    window = features_v2(stage).filter(F.col("dt") == F.lit(str(target)).cast("date"))
    shared = V1_HISTORY + V2_EXTRA
    ahead = forward_features(stage, as_of).select(*SERIES_KEY, *[F.col(c).alias(f"f_{c}") for c in shared])
    joined = window.join(ahead, SERIES_KEY)
    one = joined.agg(
        F.count(F.lit(1)).alias("series"),
        *[F.max(F.abs(F.col(c) - F.col(f"f_{c}"))).alias(c) for c in shared],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("max_difference"))
                      for c in shared])
    return one.select("series", F.inline(pairs))

"""Window, feature and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.plans import features as f
from shelfwise.registry import inputs, query
from shelfwise.registry.oracle import TABLES, oracle
from shelfwise.schemas import DAILY_KEY

KEY = "store_id, product_id, dt"
FLOATS_V1 = "target_sale_amount sales_lag_1 sales_lag_7 sales_lag_14 sales_rolling_mean_7 sales_rolling_mean_14 " \
            "sales_rolling_std_7 stockout_rolling_mean_7"
FLOATS_V2 = FLOATS_V1 + " " + " ".join(f.V2_EXTRA)
FLOATS_V3 = FLOATS_V2 + " discount " + " ".join(f.WEATHER)
V1_COLS = ", ".join([*DAILY_KEY, "target_sale_amount", *f.IDS[2:], *f.CALENDAR, *f.V1_HISTORY, "source_file"])
V2_COLS = ", ".join(f._V2_COLUMNS)
V3_COLS = ", ".join([*f._V2_COLUMNS, *f.COMMERCIAL, *f.WEATHER])
V1_READY = " AND ".join(f"{c} IS NOT NULL" for c in f.V1_HISTORY)

CUTOFF = "2024-07-02"
PARITY_CUTOFF = "2024-07-01"


def forward_sql(as_of: str) -> str:
    """Next-day rows at a cutoff, from the 28 days ending there."""
    back = lambda n: f"dt = DATE '{as_of}' - {n - 1}"
    since = lambda n: f"dt > DATE '{as_of}' - {n}"
    cols = [f"max(sale_amount) FILTER (WHERE {back(n)}) AS sales_lag_{n}" for n in (1, 2, 3, 7, 14)]
    for k in (7, 14, 28):
        for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")):
            cols.append(f"{agg}(sale_amount) FILTER (WHERE {since(k)}) AS sales_rolling_{name}_{k}")
    cols.append(f"max(stock_hour6_22_cnt) FILTER (WHERE {back(1)}) AS stockout_lag_1")
    cols.append(f"avg(stock_hour6_22_cnt) FILTER (WHERE {since(7)}) AS stockout_rolling_mean_7")
    for c in (*f.IDS[2:], "discount", "activity_flag"):
        cols.append(f"max({c}) FILTER (WHERE {back(1)}) AS {c}")
    inner = ",\n       ".join(cols)
    return f"""SELECT *, sales_rolling_mean_7 - sales_rolling_mean_28 AS recent_growth_7_vs_28,
       CAST(isodow(DATE '{as_of}' + 1) AS INTEGER) AS day_of_week,
       CASE WHEN isodow(DATE '{as_of}' + 1) >= 6 THEN 1 ELSE 0 END AS is_weekend, 0 AS holiday_flag
FROM (SELECT store_id, product_id, {inner}
      FROM raw_rows WHERE dt > DATE '{as_of}' - 28 AND dt <= DATE '{as_of}' GROUP BY 1, 2)"""


TABLES["forward_rows"] = forward_sql(CUTOFF)
TABLES["forward_parity"] = forward_sql(PARITY_CUTOFF)


def _window(name: str, cols: list[str], doubles: str):
    """A registered query returning only some window columns."""
    query(name, oracle(f"SELECT {KEY}, {', '.join(cols)} FROM features", doubles, "dt"))(
        lambda s, d: f.base_rows(inputs.staging(s, d)).select(
            *DAILY_KEY, *[c.alias(n) for n, c in f._history_columns(cols).items()]))


_window("lags", [f"sales_lag_{n}" for n in (1, 2, 3, 7, 14)] + ["stockout_lag_1"],
        " ".join(f"sales_lag_{n}" for n in (1, 2, 3, 7, 14)))
for _kind in ("mean", "std", "max"):
    _cols = [f"sales_rolling_{_kind}_{k}" for k in (7, 14, 28)]
    if _kind == "mean":
        _cols.append("stockout_rolling_mean_7")
    _window(f"rolling_{_kind}", _cols, " ".join(_cols))
_window("history_count", ["history_count_28"], "")

query("growth_7_vs_28", oracle(f"SELECT {KEY}, recent_growth_7_vs_28 FROM features",
                               "recent_growth_7_vs_28", "dt"))(
    lambda s, d: f.features_v2(inputs.staging(s, d)).select(*DAILY_KEY, "recent_growth_7_vs_28"))

query("features_v1", oracle(f"SELECT {V1_COLS} FROM features", FLOATS_V1, "dt"))(
    lambda s, d: f.features_v1(inputs.staging(s, d)))
query("features_v2", oracle(f"SELECT {V2_COLS} FROM features", FLOATS_V2, "dt"))(
    lambda s, d: f.features_v2(inputs.staging(s, d)))
query("features_v3", oracle(f"SELECT {V3_COLS} FROM features", FLOATS_V3, "dt"))(
    lambda s, d: f.features_v3(inputs.staging(s, d)))
query("three_key_join", oracle(f"SELECT {V3_COLS} FROM features", FLOATS_V3, "dt"))(
    lambda s, d: f.with_exogenous(f.features_v2(inputs.staging(s, d)), inputs.fact(s, d)))
for _src in ("train", "eval"):
    query(f"features_v1_{_src}", oracle(
        f"SELECT {V1_COLS} FROM features WHERE {V1_READY} AND source_file = '{_src}.parquet'", FLOATS_V1, "dt"))(
        lambda s, d, src=_src: f.model_ready_v1(f.features_v1(inputs.staging(s, d)), f"{src}.parquet"))

query("complete_history_filter", oracle(
    f"SELECT {KEY}, history_count_28, sales_rolling_mean_28 FROM features WHERE history_count_28 = 28",
    "sales_rolling_mean_28", "dt"))(
    lambda s, d: f.full_history(f.features_v2(inputs.staging(s, d)))
    .select(*DAILY_KEY, "history_count_28", "sales_rolling_mean_28"))

query("period_slice", oracle(
    f"SELECT {KEY}, sale_amount FROM fact WHERE dt BETWEEN DATE '2024-06-12' AND DATE '2024-06-25'",
    "sale_amount", "dt"))(
    lambda s, d: f.split(inputs.fact(s, d), "validation").select(*DAILY_KEY, "sale_amount"))

query("temporal_splits", oracle(f"""
SELECT CASE WHEN dt <= DATE '2024-06-11' THEN 'dev_train' WHEN dt <= DATE '2024-06-25' THEN 'validation'
            WHEN dt <= DATE '2024-07-02' THEN 'holdout' END AS split,
       count(*) FILTER (WHERE {V1_READY}) AS v1_rows,
       count(*) FILTER (WHERE history_count_28 = 28) AS v2_rows, min(dt) AS first_date, max(dt) AS last_date
FROM features GROUP BY 1""", "", "first_date last_date"))(
    lambda s, d: f.split_counts(f.features_v3(inputs.staging(s, d))))

FORWARD_FLOATS = " ".join(c for c in f.FEATURE_SETS["V3C"] if c.startswith("sales_")) + \
    " stockout_rolling_mean_7 recent_growth_7_vs_28 discount"
query("forward_features", oracle(
    f"SELECT {', '.join(f.FEATURE_SETS['V3C'])} FROM forward_rows", FORWARD_FLOATS))(
    lambda s, d: f.forward_features(inputs.staging(s, d), CUTOFF))

query("forward_history_gate", oracle(f"""
SELECT u.check_name AS "check", u.actual, CAST(0 AS BIGINT) AS expected, u.actual = 0 AS ok FROM (
  SELECT unnest(['series_with_duplicate_days', 'series_without_28_days']) AS check_name,
         unnest([count(*) FILTER (WHERE n > days), count(*) FILTER (WHERE days <> 28)]) AS actual
  FROM (SELECT store_id, product_id, count(*) FILTER (WHERE dt > DATE '{CUTOFF}' - 28) AS n,
               count(DISTINCT dt) FILTER (WHERE dt > DATE '{CUTOFF}' - 28) AS days
        FROM raw_rows WHERE dt <= DATE '{CUTOFF}' GROUP BY 1, 2)) u"""))(
    lambda s, d: f.history_gate(inputs.staging(s, d), CUTOFF))

_SHARED = f.V1_HISTORY + f.V2_EXTRA
query("feature_parity", oracle(
    "SELECT series, unnest([" + ", ".join(f"'{c}'" for c in _SHARED) + "]) AS feature, unnest(["
    + ", ".join(f"CAST({c} AS DOUBLE)" for c in _SHARED) + "]) AS max_difference FROM (SELECT count(*) AS series, "
    + ", ".join(f"max(abs(w.{c} - n.{c})) AS {c}" for c in _SHARED)
    + " FROM features w JOIN forward_parity n ON w.store_id = n.store_id AND w.product_id = n.product_id"
    + f" WHERE w.dt = DATE '{PARITY_CUTOFF}' + 1)", "max_difference"))(
    lambda s, d: f.feature_parity(inputs.staging(s, d), PARITY_CUTOFF))

_TRAIN_COLS = ", ".join("CAST(is_weekend AS INTEGER) AS is_weekend" if c == "is_weekend" else c
                        for c in f.FEATURE_SETS["V3C"])
query("training_frame", oracle(
    f"SELECT dt, target_sale_amount, {_TRAIN_COLS} FROM features WHERE history_count_28 = 28",
    FORWARD_FLOATS + " target_sale_amount", "dt"))(
    lambda s, d: f.training_frame(f.features_v3(inputs.staging(s, d)), CUTOFF))

query("finite_gate", oracle(
    "SELECT check_name AS \"check\", actual, CAST(0 AS BIGINT) AS expected, actual = 0 AS ok FROM (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in ["target_sale_amount", *f.FEATURE_SETS["V3C"], "target_nonnegative"])
    + "]) AS check_name, unnest(["
    + ", ".join(f"count(*) FILTER (WHERE isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)))"
                for c in ["target_sale_amount", *f.FEATURE_SETS["V3C"]])
    + ", count(*) FILTER (WHERE target_sale_amount < 0)]) AS actual FROM features WHERE history_count_28 = 28)"))(
    lambda s, d: f.training_gate(f.training_frame(f.features_v3(inputs.staging(s, d)), CUTOFF)))

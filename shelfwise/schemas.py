"""Declared schemas of every layer table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "long": LongType(),
    "int": IntegerType(),
    "short": ShortType(),
    "double": DoubleType(),
    "string": StringType(),
    "date": DateType(),
    "timestamp": TimestampType(),
    "boolean": BooleanType(),
    "doubles": ArrayType(DoubleType()),
    "ints": ArrayType(IntegerType()),
}


def _table(text: str) -> StructType:
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        fields.append(StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return StructType(fields)


SERIES_KEY = ["store_id", "product_id"]
DAILY_KEY = ["store_id", "product_id", "dt"]
DECISION_KEY = ["store_id", "product_id", "decision_date"]

_SOURCE = (
    "city_id long, store_id long, management_group_id long, first_category_id long,"
    "second_category_id long, third_category_id long, product_id long, dt string,"
    "sale_amount double, hours_sale doubles, stock_hour6_22_cnt int,"
    "hours_stock_status ints, discount double, holiday_flag int, activity_flag int,"
    "precpt double, avg_temperature double, avg_humidity double, avg_wind_level double"
)
SOURCE_RETAIL_DAILY = _table(_SOURCE)
RAW_RETAIL_DAILY = _table(_SOURCE + ", source_file string!, ingested_at timestamp!")

STAGING_RETAIL_DAILY = _table(
    "city_id long!, store_id long!, management_group_id long!, first_category_id long!,"
    "second_category_id long!, third_category_id long!, product_id long!, dt date!,"
    "sale_amount double!, stock_hour6_22_cnt int!, discount double!, holiday_flag int!,"
    "activity_flag int!, precpt double!, avg_temperature double!, avg_humidity double!,"
    "avg_wind_level double!, source_file string!"
)
STAGING_RETAIL_HOURLY = _table(
    "store_id long!, product_id long!, dt date!, hour_of_day int!, sale_amount double!,"
    "stock_status int!, source_file string!"
)
DIM_PRODUCT = _table(
    "product_id long!, first_category_id long!, second_category_id long!, third_category_id long!"
)
DIM_STORE = _table("store_id long!, city_id long!, management_group_id long!")
DIM_DATE = _table(
    "dt date!, year int!, month int!, day int!, day_of_week int!, day_name string!,"
    "week_of_year int!, is_weekend boolean!"
)
BRIDGE_STORE_GROUP = _table("store_id long!, management_group_id long!")
FACT_DAILY_DEMAND = _table(
    "store_id long!, product_id long!, dt date!, sale_amount double!, stockout_hours short!,"
    "discount double!, holiday_flag short!, activity_flag short!, precpt double!,"
    "avg_temperature double!, avg_humidity double!, avg_wind_level double!, source_file string!"
)
FEATURE_DAILY_DEMAND = _table(
    "store_id long!, product_id long!, dt date!, target_sale_amount double!,"
    "first_category_id long!, second_category_id long!, third_category_id long!,"
    "day_of_week int!, is_weekend boolean!, holiday_flag short!, sales_lag_1 double,"
    "sales_lag_7 double, sales_lag_14 double, sales_rolling_mean_7 double,"
    "sales_rolling_mean_14 double, sales_rolling_std_7 double, stockout_lag_1 short,"
    "stockout_rolling_mean_7 double, source_file string!"
)
INVENTORY_POSITION = _table(
    "store_id long!, product_id long!, as_of_date date!, on_hand_quantity double!,"
    "on_order_quantity double!, backorder_quantity double!, expected_next_receipt_date date,"
    "unit_cost double, warehouse_capacity_remaining double"
)
SUPPLIER_POLICY = _table(
    "store_id long!, product_id long!, supplier_id long!, average_lead_time_days double!,"
    "lead_time_std_days double!, minimum_order_quantity double!, case_pack_size double!,"
    "target_service_level double!, planning_horizon_days int!, supplier_unit_cost double,"
    "on_time_delivery_rate double, active_flag boolean!"
)
PRODUCT_PRIORITY = _table(
    "store_id long!, product_id long!, stockout_cost_per_unit double,"
    "holding_cost_per_unit_day double, shelf_life_days int, working_capital_limit double,"
    "priority_weight double!"
)
FORECAST = _table(
    "store_id long!, product_id long!, as_of_date date!, target_date date!, prediction double!,"
    "model_id string!, input_policy string!, run_id string!"
)
FORECAST_EVALUATION = _table(
    "store_id long!, product_id long!, dt date!, actual double!, prediction double!,"
    "rolling_prediction double!"
)
RUN_EVENT = _table("run_id string!, stage string!, status string!, ts timestamp!, details string")
SOURCE_REGISTRY = _table("source_file string!, fingerprint string!, row_count long!")
MODEL_MANIFEST = _table(
    "model_id string!, data_fingerprint string!, feature_set string!, parameters string!, path string!,"
    "artifact_sha256 string!"
)

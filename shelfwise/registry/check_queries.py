"""Warehouse builds, data-quality gates and source profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import compare, gates
from shelfwise.plans import profiling as p
from shelfwise.plans import warehouse as w
from shelfwise.registry import inputs, query
from shelfwise.registry.oracle import oracle, rounded
from shelfwise.schemas import DAILY_KEY, STAGING_RETAIL_DAILY
from shelfwise.sources import versions
from shelfwise.sources.storage import new_path, written

FACT_FLOATS = "sale_amount discount precpt avg_temperature avg_humidity avg_wind_level"
STAGE_COLS = [f.name for f in STAGING_RETAIL_DAILY]
STAGE_SQL = f"SELECT {', '.join(STAGE_COLS)} FROM raw_rows"


def gate_rows(pairs: list[tuple[str, str]], source: str, expected: str = "CAST(0 AS BIGINT)") -> str:
    """SQL rows (check, actual, expected, ok) of several counts over one source."""
    names = ", ".join(f"'{n}'" for n, _ in pairs)
    counts = ", ".join(f"CAST({c} AS BIGINT)" for _, c in pairs)
    return f"""SELECT check_name AS "check", actual, {expected} AS expected, actual = {expected} AS ok
FROM (SELECT unnest([{names}]) AS check_name, unnest([{counts}]) AS actual FROM {source})"""


def broken(cond: str) -> str:
    return f"count(*) FILTER (WHERE NOT ({cond}))"


# --- warehouse ---------------------------------------------------------------

query("load_staging", oracle(STAGE_SQL, FACT_FLOATS, "dt"))(lambda s, d: inputs.staging(s, d))
FACT_SQL = oracle("SELECT * FROM fact", FACT_FLOATS, "dt")
query("load_fact", FACT_SQL)(lambda s, d: inputs.fact(s, d))
query("fact_daily_demand", oracle("""
SELECT store_id, product_id, dt, sale_amount, stockout_hours, discount, holiday_flag, activity_flag, precpt,
       avg_temperature, avg_humidity, avg_wind_level, source_file FROM fact""", FACT_FLOATS, "dt"))(
    lambda s, d: inputs.fact(s, d))
query("dim_product", oracle("SELECT * FROM dim_product"))(lambda s, d: w.dim_product(inputs.staging(s, d)))
query("dim_store", oracle("SELECT * FROM dim_store"))(lambda s, d: w.dim_store(inputs.staging(s, d)))
query("store_dimension", oracle("""
SELECT management_group_id, city_id, count(*) AS stores FROM dim_store GROUP BY 1, 2"""))(
    lambda s, d: w.dim_store(inputs.staging(s, d)).groupBy("management_group_id", "city_id")
    .agg(F.count(F.lit(1)).alias("stores")))
query("dim_date", oracle("SELECT * FROM dim_date", "", "dt"))(lambda s, d: w.dim_date(inputs.staging(s, d)))
query("bridge_store_group", oracle("SELECT * FROM bridge"))(
    lambda s, d: w.bridge_store_group(inputs.staging(s, d)))
query("distinct_dimension", oracle("SELECT DISTINCT first_category_id, second_category_id, third_category_id FROM raw_rows"))(
    lambda s, d: inputs.staging(s, d).select("first_category_id", "second_category_id", "third_category_id").distinct())
query("except_distinct", oracle("""
SELECT DISTINCT store_id, management_group_id FROM raw_rows
EXCEPT SELECT store_id, management_group_id FROM dim_store"""))(
    lambda s, d: w.bridge_store_group(inputs.staging(s, d)).subtract(
        w.dim_store(inputs.staging(s, d)).select("store_id", "management_group_id")))
query("hourly_explode", oracle("""
SELECT store_id, product_id, dt, hour_of_day, sale_amount, stock_status, source_file FROM hours""",
    "sale_amount", "dt"))(lambda s, d: w.hourly(inputs.raw_hourly(s, d)))


def _dimensions(s, d):
    stage = inputs.staging(s, d)
    return written(w.dim_product(stage), "dim_product"), written(w.dim_date(stage), "dim_date")


query("star_join", oracle("""
SELECT f.store_id, f.product_id, f.dt, f.sale_amount, p.first_category_id, p.second_category_id,
       p.third_category_id, d.day_of_week, d.is_weekend, d.week_of_year
FROM fact f JOIN dim_product p ON p.product_id = f.product_id JOIN dim_date d ON d.dt = f.dt""",
    "sale_amount", "dt"))(
    lambda s, d: w.star_join(inputs.fact(s, d), *_dimensions(s, d)).select(
        *DAILY_KEY, "sale_amount", "first_category_id", "second_category_id", "third_category_id",
        "day_of_week", "is_weekend", "week_of_year"))


# --- gates -------------------------------------------------------------------

query("gate_unique_key", oracle(
    'SELECT \'duplicate_business_keys\' AS "check", count(*) AS actual, CAST(0 AS BIGINT) AS expected, count(*) = 0 AS ok '
    "FROM (SELECT 1 FROM fact GROUP BY store_id, product_id, dt HAVING count(*) > 1)"))(
    lambda s, d: gates.unique_key_gate(inputs.fact(s, d), DAILY_KEY, "duplicate_business_keys"))

# Order lines do repeat their natural key, which shows the check with findings.
query("duplicate_order_lines", oracle("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""))(
    lambda s, d: gates.duplicate_keys(s.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]))

_RULES = [
    ("stock_hours_0_16", broken("stock_hour6_22_cnt BETWEEN 0 AND 16")),
    ("sale_nonnegative", broken("sale_amount >= 0")),
    ("holiday_flag_binary", broken("holiday_flag IN (0, 1)")),
    ("activity_flag_binary", broken("activity_flag IN (0, 1)")),
    ("sale_finite", broken("NOT isnan(sale_amount) AND NOT isinf(sale_amount)")),
]
query("gate_check_constraints", oracle(gate_rows(_RULES, "raw_rows")))(
    lambda s, d: gates.rule_violations(inputs.staging(s, d), w.staging_rules()))
query("gate_hourly_constraints", oracle(gate_rows(
    [("hour_0_23", broken("hour_of_day BETWEEN 0 AND 23")), ("status_binary", broken("stock_status IN (0, 1)")),
     ("sale_nonnegative", broken("sale_amount >= 0"))], "hours")))(
    lambda s, d: gates.rule_violations(w.hourly(inputs.raw_hourly(s, d)), {
        "hour_0_23": F.col("hour_of_day").between(0, 23),
        "status_binary": F.col("stock_status").isin(0, 1),
        "sale_nonnegative": F.col("sale_amount") >= 0}))

query("gate_not_null", oracle(
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in STAGE_COLS) + '] ) AS "column", unnest(['
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in STAGE_COLS) + "]) AS null_count, unnest(["
    + ", ".join(f"100e0 * count(*) FILTER (WHERE {c} IS NULL) / count(*)" for c in STAGE_COLS)
    + "]) AS null_percentage FROM raw_rows"))(
    lambda s, d: gates.null_profile(inputs.staging(s, d), STAGE_COLS))

query("gate_foreign_keys", oracle(" UNION ALL ".join(
    f'SELECT \'orphan_{n}\' AS "check", count(*) AS actual, CAST(0 AS BIGINT) AS expected, count(*) = 0 AS ok '
    f"FROM fact f LEFT JOIN {t} x ON x.{k} = f.{k} WHERE x.{k} IS NULL"
    for n, t, k in (("products", "dim_product", "product_id"), ("stores", "dim_store", "store_id"),
                    ("dates", "dim_date", "dt")))))(
    lambda s, d: gates.all_of([
        gates.foreign_key_gate(inputs.fact(s, d), dim(inputs.staging(s, d)), [k], f"orphan_{n}")
        for n, dim, k in (("products", w.dim_product, "product_id"), ("stores", w.dim_store, "store_id"),
                          ("dates", w.dim_date, "dt"))]))

# Against suppliers in credit only: order lines of the others are orphans.
query("anti_orphans", oracle("""
SELECT l.l_suppkey, count(*) AS rows FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0)
GROUP BY l.l_suppkey"""))(
    lambda s, d: gates.orphans(
        s.read.parquet(f"{d}/lineitem.parquet"),
        s.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey"),
        ["l_suppkey"]))

query("gate_array_shape", oracle("""
SELECT 'hours_sale' AS "column", CAST(24 AS INTEGER) AS length, count(*) AS rows FROM raw_rows
UNION ALL SELECT 'hours_stock_status' AS "column", CAST(24 AS INTEGER) AS length, count(*) AS rows FROM raw_rows"""))(
    lambda s, d: p.array_shapes(inputs.raw_hourly(s, d)))
query("gate_city_unique", oracle("""
SELECT 'stores_with_two_cities' AS "check", count(*) AS actual, CAST(0 AS BIGINT) AS expected, count(*) = 0 AS ok
FROM (SELECT store_id FROM raw_rows GROUP BY store_id HAVING count(DISTINCT city_id) > 1)"""))(
    lambda s, d: gates.single_value_gate(inputs.staging(s, d), "store_id", "city_id", "stores_with_two_cities"))


def _expected(s, d):
    """Sizes the layers must have, from the order lines themselves."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey div 5 AS store", "l_partkey % 40 AS product")
    series = lines.groupBy("store", "product").agg(F.lit(1).alias("one"))
    r = series.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("product").alias("p"),
                   F.countDistinct("store").alias("s")).first()
    return {"rows": r["n"] * 97, "products": r["p"], "stores": r["s"], "dates": 97}


_SIZES = """(SELECT count(*) * 97 AS n, count(DISTINCT product_id) AS p, count(DISTINCT store_id) AS s
 FROM (SELECT DISTINCT store_id, product_id FROM cells))"""


def _size_row(check: str, table: str, expected: str) -> str:
    return (f'SELECT \'{check}\' AS "check", (SELECT count(*) FROM {table}) AS actual, '
            f"CAST({expected} AS BIGINT) AS expected, (SELECT count(*) FROM {table}) = {expected} AS ok FROM {_SIZES}")


_ROWS_SQL = " UNION ALL ".join([
    _size_row("staging_rows", "raw_rows", "n"), _size_row("fact_rows", "fact", "n"),
    _size_row("product_rows", "dim_product", "p"), _size_row("store_rows", "dim_store", "s"),
    _size_row("date_rows", "dim_date", "97")])


def _row_gates(s, d):
    stage, want = inputs.staging(s, d), _expected(s, d)
    layers = [("staging_rows", stage, "rows"), ("fact_rows", w.fact(stage), "rows"),
              ("product_rows", w.dim_product(stage), "products"), ("store_rows", w.dim_store(stage), "stores"),
              ("date_rows", w.dim_date(stage), "dates")]
    return gates.all_of([gates.row_count_gate(df, n, want[k]) for n, df, k in layers])


query("gate_row_counts", oracle(_ROWS_SQL))(_row_gates)

_NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in STAGE_COLS)
query("warehouse_gates", oracle(" UNION ALL ".join([
    _ROWS_SQL, gate_rows([("null_values", _NULLS)], "raw_rows"),
    gate_rows([("duplicate_business_keys", "count(*)")],
              "(SELECT 1 FROM fact GROUP BY store_id, product_id, dt HAVING count(*) > 1)"),
    gate_rows(_RULES, "raw_rows"),
    *[gate_rows([(f"orphan_{n}", "count(*)")],
                f"(SELECT 1 FROM fact f LEFT JOIN {t} x ON x.{k} = f.{k} WHERE x.{k} IS NULL)")
      for n, t, k in (("products", "dim_product", "product_id"), ("stores", "dim_store", "store_id"),
                      ("dates", "dim_date", "dt"))],
    gate_rows([("stores_with_two_cities", "count(*)")],
              "(SELECT 1 FROM raw_rows GROUP BY store_id HAVING count(DISTINCT city_id) > 1)")])))(
    lambda s, d: _warehouse_gates(s, d))


def _warehouse_gates(s, d):
    """The gates as they were stored with the layers they admitted."""
    built = w.build(s, new_path(s, "warehouse"), inputs.staging(s, d), _expected(s, d))
    return built.read(versions.GATES, gates.counted(s, {"none": 0}).schema)


query("int_safety_cast", oracle(gate_rows(
    [("l_quantity", broken("l_quantity = floor(l_quantity)")),
     ("l_extendedprice", broken("l_extendedprice = floor(l_extendedprice)"))], "lineitem")))(
    lambda s, d: gates.integral_or_null(s.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_extendedprice"]))
query("integer_columns", oracle("""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem"""))(
    lambda s, d: gates.as_integers(
        s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]))


# --- profiles ----------------------------------------------------------------

_CARD = ["city_id", "store_id", "product_id", "dt", "first_category_id", "second_category_id", "third_category_id"]
query("cardinality_profile", oracle(" UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values '
    "FROM raw_rows" for c in _CARD)))(
    lambda s, d: p.cardinality_profile(inputs.raw(s, d), _CARD))

query("cardinality_sketches", oracle(" UNION ALL ".join(
    f'SELECT source_file, \'{c}\' AS "column", count(DISTINCT {c}) AS distinct_values, TRUE AS within_2_percent, '
    "TRUE AS merged_as_one_pass FROM raw_rows GROUP BY source_file" for c in _CARD)))(
    lambda s, d: p.cardinality_sketches(inputs.raw(s, d), _CARD, "source_file", "dt"))

query("duplicate_profile", oracle("""
SELECT CAST(coalesce(sum(surplus), 0) AS BIGINT) AS exact_duplicate_rows,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_duplicate_keys
FROM (SELECT l_orderkey, l_linenumber, sum(n) AS n, sum(n - 1) AS surplus
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, count(*) AS n
            FROM lineitem GROUP BY ALL) GROUP BY 1, 2)"""))(
    lambda s, d: p.duplicate_profile(
        s.read.parquet(f"{d}/lineitem.parquet"),
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"],
        ["l_orderkey", "l_linenumber"]))

query("grain_profile", oracle("""
SELECT count(*) AS series, CAST(sum(n) AS BIGINT) AS rows
FROM (SELECT count(*) AS n FROM raw_rows GROUP BY store_id, product_id)"""))(
    lambda s, d: p.grain_profile(inputs.staging(s, d)))

query("date_parse_profile", oracle("""
SELECT count(*) FILTER (WHERE dt IS NULL) AS invalid_dates, count(DISTINCT dt) AS unique_dates,
       min(dt) AS first_date, max(dt) AS last_date,
       CAST(date_diff('day', min(dt), max(dt)) + 1 AS INTEGER) AS calendar_days
FROM (SELECT TRY_CAST(CAST(dt AS VARCHAR) AS DATE) AS dt FROM raw_rows)""", "", "first_date last_date"))(
    lambda s, d: p.date_profile(inputs.raw(s, d), "dt"))

query("describe_sales", oracle("""
SELECT count(sale_amount) AS count, 100e0 * count(*) FILTER (WHERE sale_amount = 0) / count(*) AS zero_percentage,
       count(*) FILTER (WHERE sale_amount < 0) AS negative_rows, avg(sale_amount) AS mean,
       stddev_samp(sale_amount) AS std, min(sale_amount) AS min, max(sale_amount) AS max,
       quantile_cont(sale_amount, 0.25) AS p25, quantile_cont(sale_amount, 0.5) AS p50,
       quantile_cont(sale_amount, 0.75) AS p75 FROM raw_rows""",
    "zero_percentage mean std min max p25 p50 p75"))(
    lambda s, d: p.describe_sales(inputs.staging(s, d)))

query("hourly_consistency", oracle("""
SELECT count(*) AS rows, count(*) FILTER (WHERE abs(total - day_sales) > 1e-6) AS mismatches,
       100e0 * count(*) FILTER (WHERE abs(total - day_sales) > 1e-6) / count(*) AS mismatch_percentage
FROM (SELECT max(day_sales) AS day_sales, sum(sale_amount) AS total FROM hours GROUP BY store_id, product_id, dt)""",
    "mismatch_percentage"))(lambda s, d: p.hourly_consistency(inputs.raw_hourly(s, d)))

query("largest_differences", oracle("""
SELECT store_id, product_id, dt, abs(max(day_sales) - sum(sale_amount)) AS difference
FROM hours GROUP BY store_id, product_id, dt ORDER BY difference DESC, store_id, product_id, dt LIMIT 10""",
    "difference", "dt"))(lambda s, d: p.largest_hourly_differences(inputs.raw_hourly(s, d)))

query("category_consistency", oracle("""
SELECT count(*) AS products, count(*) FILTER (WHERE n > 1) AS inconsistent_products FROM (
  SELECT product_id, count(*) AS n FROM (SELECT DISTINCT product_id, first_category_id, second_category_id,
  third_category_id FROM raw_rows) GROUP BY product_id)"""))(
    lambda s, d: p.category_consistency(inputs.staging(s, d)))

query("stock_status_profile", oracle("""
SELECT stock_hour6_22_cnt, stock_status AS status, count(*) AS rows
FROM (SELECT DISTINCT store_id, product_id, dt, stock_hour6_22_cnt, stock_status FROM hours) GROUP BY 1, 2"""))(
    lambda s, d: p.stock_status_profile(inputs.raw_hourly(s, d)))
query("stock_status_values", oracle("SELECT stock_status AS status, count(*) AS hours FROM hours GROUP BY 1"))(
    lambda s, d: p.stock_status_values(inputs.raw_hourly(s, d)))

query("stock_count_relationship", oracle("""
SELECT count(*) AS rows, count(*) FILTER (WHERE ones = c) AS matches_ones,
       100e0 * count(*) FILTER (WHERE ones = c) / count(*) AS matches_ones_percentage,
       count(*) FILTER (WHERE zeros = c) AS matches_zeros,
       100e0 * count(*) FILTER (WHERE zeros = c) / count(*) AS matches_zeros_percentage
FROM (SELECT max(stock_hour6_22_cnt) AS c,
             count(*) FILTER (WHERE stock_status = 1 AND hour_of_day BETWEEN 6 AND 21) AS ones,
             count(*) FILTER (WHERE stock_status = 0 AND hour_of_day BETWEEN 6 AND 21) AS zeros
      FROM hours GROUP BY store_id, product_id, dt)""", "matches_ones_percentage matches_zeros_percentage"))(
    lambda s, d: p.stock_count_relationship(inputs.raw_hourly(s, d)))

query("stockout_sales_profile", oracle(f"""
SELECT CASE WHEN stock_hour6_22_cnt <= 0 THEN 'No stockout' WHEN stock_hour6_22_cnt <= 4 THEN '1-4 hours'
            WHEN stock_hour6_22_cnt <= 8 THEN '5-8 hours' WHEN stock_hour6_22_cnt <= 12 THEN '9-12 hours'
            ELSE '13-16 hours' END AS stockout_band, count(*) AS rows,
       {rounded("avg(sale_amount)", 3)} AS average_sales,
       {rounded("100e0 * count(*) FILTER (WHERE sale_amount = 0) / count(*)", 3)} AS zero_sales_rate,
       {rounded("avg(stock_hour6_22_cnt)", 3)} AS average_stockout_hours,
       {rounded("quantile_cont(sale_amount, 0.5)", 3)} AS median_sales FROM raw_rows GROUP BY 1"""))(
    lambda s, d: p.stockout_sales_profile(inputs.staging(s, d)))

query("population_compare", oracle("""
SELECT CASE WHEN l + r = 2 THEN 'both' WHEN l = 1 THEN 'left_only' ELSE 'right_only' END AS indicator, count(*) AS keys
FROM (SELECT store_id, product_id, max(CASE WHEN source_file = 'train.parquet' AND sale_amount > 0 THEN 1 ELSE 0 END) AS l,
             max(CASE WHEN source_file = 'eval.parquet' AND sale_amount > 0 THEN 1 ELSE 0 END) AS r
      FROM raw_rows GROUP BY 1, 2) WHERE l + r > 0 GROUP BY 1"""))(
    lambda s, d: compare.population_compare(
        inputs.staging(s, d).filter("source_file = 'train.parquet' AND sale_amount > 0"),
        inputs.staging(s, d).filter("source_file = 'eval.parquet' AND sale_amount > 0"),
        ["store_id", "product_id"]))

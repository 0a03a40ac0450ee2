"""Same answers when one key holds a third of the rows, and under other physical plans."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from check_oracle import normal

HOT = ["network_summary", "stockout_sales_profile", "describe_sales", "product_profile", "pct_rank_avg", "features_v2",
       "source_fingerprint", "duplicate_profile", "reconcile_bag_diff", "gate_foreign_keys", "control_tower",
       "budget_sensitivity", "run_audit_latest"]


def compare(spark, db, sf_dir, name):
    df = entry_points.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    cur = db.execute(entry_points.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    want = [tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()]
    assert got and sorted(tuple(map(normal, r)) for r in got) == sorted(tuple(map(normal, r)) for r in want)


def views(sf_dir, hot):
    db = duckdb.connect()
    for t in ("lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hot}/{t}.parquet/*.parquet'")
    for t in ("supplier", "customer", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.fixture(scope="module")
def hot_dir(spark, sf_dir, tmp_path_factory):
    """A third of the order lines are one line repeated; a third of the events one user's."""
    out = str(tmp_path_factory.mktemp("hot"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = F.col("l_orderkey") % 3 == 0
    first = lines.orderBy(*lines.columns).first()
    lines.select(*[
        F.when(one, F.lit(first[c])).otherwise(F.col(c)).cast(lines.schema[c].dataType).alias(c) for c in lines.columns
    ]).write.parquet(f"{out}/lineitem.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id"))).write.parquet(
        f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", HOT)
def test_hot_keys(spark, sf_dir, hot_dir, name):
    compare(spark, views(sf_dir, hot_dir), hot_dir, name)


@pytest.mark.parametrize("name", ["control_tower", "star_join", "pct_rank_avg", "percent_of_total"])
def test_same_rows_without_size_based_broadcast(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    change = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "13",
              "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in change}
    for k, v in change.items():
        spark.conf.set(k, v)
    try:
        compare(spark, db, sf_dir, name)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)

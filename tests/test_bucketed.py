"""Stored buckets: same rows from any session, and plans that move none of them."""

import re

import pytest
from pyspark.sql import functions as F

from shelfwise.registry import stored_queries
from shelfwise.schemas import SERIES_KEY
from shelfwise.sources import bucketed, storage


def exchanges(df):
    """Shuffles of the plan; broadcasts are none."""
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_star_join_and_windows_leave_the_fact_where_it_is(spark, sf_dir):
    st = stored_queries.stored(spark, sf_dir)
    assert exchanges(stored_queries._star(spark, sf_dir)) == []
    windows = st.fact.select(*SERIES_KEY, stored_queries.features.lag("sale_amount", 7).alias("x"))
    assert exchanges(windows) == []


def test_series_meet_in_their_buckets(spark, sf_dir, no_broadcast):
    assert exchanges(stored_queries._unusual(spark, sf_dir)) == []


def table(spark, n, step=1):
    return spark.range(0, n, step).select(
        (F.col("id") % 40).alias("store_id"), (F.col("id") % 7).alias("product_id"), F.col("id").alias("a b"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("note"))


def test_tables_of_different_size_join_without_a_shuffle(spark, no_broadcast):
    large, small = table(spark, 3000), table(spark, 300, 2)
    paths = [storage.new_path(spark, "bucketed") for _ in range(2)]
    bucketed.write(large, paths[0], SERIES_KEY, ["a b"], 4)
    bucketed.write(small, paths[1], SERIES_KEY, buckets=2)
    spark.conf.set("spark.sql.bucketing.coalesceBucketsInJoin.enabled", "true")
    try:
        other = bucketed.read(spark, paths[1]).select(*SERIES_KEY, F.col("a b").alias("other"))
        got = bucketed.read(spark, paths[0]).join(other, SERIES_KEY)
        assert exchanges(got) == []
        want = large.join(small.select(*SERIES_KEY, F.col("a b").alias("other")), SERIES_KEY)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.bucketing.coalesceBucketsInJoin.enabled")


def test_a_session_that_did_not_write_it_reads_it(spark, no_broadcast):
    rows, path = table(spark, 500), storage.new_path(spark, "bucketed")
    bucketed.write(rows, path, SERIES_KEY, ["a b"], 2)
    spark.sql(f"DROP TABLE {bucketed._name(path)}")  # what is known of it is gone, the files stay
    again = bucketed.read(spark, path)
    assert again.columns == rows.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert exchanges(again.groupBy(*SERIES_KEY).agg(F.max("note"))) == []


def test_unfinished_and_repeated_writes_are_refused(spark):
    path = storage.new_path(spark, "bucketed")
    table(spark, 10).write.parquet(path)  # files without a layout, as a lost job leaves them
    with pytest.raises(bucketed.Unfinished):
        bucketed.read(spark, path)
    with pytest.raises(ValueError, match="exists"):
        bucketed.write(table(spark, 10), path, SERIES_KEY)
    with pytest.raises(bucketed.Unfinished):
        bucketed.read(spark, path + "-nothing")
    empty = storage.new_path(spark, "bucketed")
    bucketed.write(table(spark, 0), empty, SERIES_KEY)
    assert bucketed.read(spark, empty).count() == 0


def test_buckets_follow_the_bytes(spark):
    assert [bucketed.buckets_for(n, 100) for n in (0, 1, 100, 101, 200, 201, 900)] == [1, 1, 1, 2, 2, 4, 16]
    with pytest.raises(ValueError):
        bucketed.write(table(spark, 1), storage.new_path(spark, "bucketed"), SERIES_KEY, buckets=0)


def test_buckets_follow_the_rows_not_their_compressed_files(spark):
    """Few distinct values are a small file, but the task of a bucket reads and sorts whole rows."""
    rows = storage.written(spark.range(200_000).select(
        (F.col("id") % 4).alias("store_id"), F.lit(1).cast("bigint").alias("product_id"), F.lit(0.0).alias("x")), "flat")
    assert bucketed.row_bytes(rows) == 200_000 * 24 > 8 * bucketed.stored_bytes(rows)
    assert bucketed.row_bytes(rows.limit(0)) == 0


def test_the_stored_layer_takes_its_buckets_from_its_rows(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(stored_queries, "_STORED", {})
    monkeypatch.setattr(bucketed, "buckets_for", lambda n, *a: asked.append(n) or 4)
    st = stored_queries.stored(spark, sf_dir)
    assert asked == [st.fact.count() * storage.written(stored_queries.inputs.staging(spark, sf_dir), "staging")._jdf.schema().defaultSize()]
    assert st.fact.rdd.getNumPartitions() <= 4 and exchanges(st.fact.groupBy(*SERIES_KEY).count()) == []

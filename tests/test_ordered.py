import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import ordered


def frame(spark, n, partitions, seed=1):
    rnd = random.Random(seed)
    # A third of the rows share one value.
    rows = [(i, 7.0 if i % 3 == 0 else float(rnd.randint(0, 40)), rnd.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, v double, amount long").repartition(partitions)


@pytest.fixture(params=[1, 3, 16])
def many(request, spark):
    """Global order must not depend on how many partitions hold it."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_global_rank_and_running_total(spark, many):
    rows, df = frame(spark, 500, 5)
    placed = ordered.globally_sorted(df, [F.desc("v"), F.col("id")])
    if many > 1:
        assert placed.select(ordered.PART).distinct().count() > 1
    ranked = ordered.with_rank(placed)
    out = {r["id"]: r for r in ordered.with_running_total(ranked, F.col("amount"), "upto").collect()}
    total = 0
    for rank, (i, v, amount) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        total += amount
        assert (out[i]["rank"], out[i]["upto"]) == (rank, total)


def test_empty_frame(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert ordered.global_rank(empty, [F.col("v"), F.col("id")]).count() == 0
    got = ordered.exact_percentiles(empty, "v", {"p": 0.5}).first()
    assert got is None or got["p"] is None


def test_percent_rank_averages_ties_and_skips_nulls(spark, many):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)], "id long, v double")
    got = {r["id"]: r["p"] for r in ordered.average_percent_rank(df, "v", ["id"], "p").collect()}
    assert got == {3: 0.25, 1: 0.625, 2: 0.625, 5: 1.0, 4: None}


def test_exact_percentiles_match_linear_interpolation(spark, many):
    import numpy as np

    rows, df = frame(spark, 301, 4)
    fractions = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = ordered.exact_percentiles(df, "v", fractions).first()
    for name, p in fractions.items():
        assert got[name] == pytest.approx(np.quantile([r[1] for r in rows], p))


def test_percentiles_by_group_with_null_group_and_weights(spark, many):
    import numpy as np

    rows = [(None if i % 4 == 0 else "g%d" % (i % 3), float(i % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    counted = ordered.value_counts(df, ["g", "v"])
    for got in (
        ordered.exact_percentiles(df, "v", {"m": 0.5}, by=["g"]),
        ordered.exact_percentiles(counted, "v", {"m": 0.5}, by=["g"], weight="n"),
    ):
        for r in got.collect():
            assert r["m"] == np.median([v for g, v in rows if g == r["g"]])
        assert got.count() == 4


def test_grand_total_is_attached_to_every_row(spark):
    _, df = frame(spark, 30, 3)
    assert {r["m"] for r in ordered.with_grand_total(df, {"m": F.max("amount")}).collect()} == {
        df.agg(F.max("amount")).first()[0]}


def test_percent_rank_with_a_value_on_most_rows(spark, many):
    df = spark.createDataFrame([(i, 1.0 if i % 3 else float(i)) for i in range(600)], "id long, v double")
    got = {r["id"]: r["p"] for r in ordered.average_percent_rank(df, "v", ["id"], "p").collect()}
    assert got == {r["id"]: r["p"] for r in df.toPandas().assign(p=lambda x: x.v.rank(pct=True)).to_dict("records")}


def test_first_rows_without_a_sort(spark):
    first_rows = ordered.first_rows
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.5, 1.5, 2.25, rng.random() * 1e6, -rng.random()]), rng.randrange(5) * 10**15, i * 3) for i in range(700)]
    df = spark.createDataFrame(rows, "v double, w long, k long")
    order = [(F.col("v"), True), (F.col("w"), False), (F.col("k"), True)]
    ranked = sorted(rows, key=lambda r: (-r[0], r[1], -r[2]))
    for k in (0, 1, 2, 10, 233, 350, 420, 699, 700, 900):
        got = df.filter(first_rows(df, order, k))
        assert sorted(map(tuple, got.collect())) == sorted(ranked[:k])
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        first_rows(df.unionByName(df), order, 701)
    assert df.limit(0).filter(first_rows(df.limit(0), order, 4)).collect() == []

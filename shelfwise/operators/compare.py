"""Multiset and population comparison of two frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.scalars import row_digest
from shelfwise.sources.storage import written


def bag_difference(a: DataFrame, b: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Symmetric multiset difference: each differing row with its side and surplus copies.

    Both directions come from one aggregation of signed counts. Copies stay a
    number, so a row repeated on a third of one side is still one record.
    """
    net = _signed(a, b, keep).groupBy(*keep).agg(F.sum("_sign").alias("_net")).filter("_net <> 0")
    return net.select(
        *keep,
        F.when(F.col("_net") > 0, "left_only").otherwise("right_only").alias("side"),
        F.abs("_net").alias("copies"),
    )


def _signed(a: DataFrame, b: DataFrame, keep: Sequence[str]) -> DataFrame:
    return a.select(*keep, F.lit(1).cast("bigint").alias("_sign")).unionByName(
        b.select(*keep, F.lit(-1).cast("bigint").alias("_sign"))
    )


def wide_bag_difference(a: DataFrame, b: DataFrame, keep: Sequence[str]) -> DataFrame:
    """:func:`bag_difference` of rows far wider than 16 bytes; both sides are read twice.

    Signed counts are added up by two hashes of the row, and only rows whose
    hashes do not cancel out are compared as they are. Two different rows that
    agree in all 128 bits, one on either side, would go unnoticed.
    """
    seeds = {f"_hash{i}": F.xxhash64(F.lit(i), *keep) for i in range(2)}
    hashed = _signed(a, b, keep).select(*[h.alias(n) for n, h in seeds.items()], "_sign")
    odd = hashed.groupBy(*seeds).agg(F.sum("_sign").alias("_net")).filter("_net <> 0").select(*seeds)
    odd = written(odd, "odd_hashes")  # with its real size known, mostly none, the wide rows need not move to meet it
    left, right = (side.select(*keep).withColumns(seeds).join(odd, list(seeds), "left_semi") for side in (a, b))
    return bag_difference(left, right, keep)


def bag_minus(a: DataFrame, b: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows of ``a`` left after taking out ``b`` copy by copy, with how many remain."""
    return bag_difference(a, b, keep).filter("side = 'left_only'").drop("side")


def population_compare(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys counted as left_only / right_only / both."""
    tagged = a.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    indicator = (
        F.when(F.col("l") + F.col("r") == 2, "both")
        .when(F.col("l") == 1, "left_only")
        .otherwise("right_only")
    )
    return sides.groupBy(indicator.alias("indicator")).agg(F.count(F.lit(1)).alias("keys"))


def absent_rows(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` lacks, one per key (insert-if-absent)."""
    return new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def table_fingerprint(df: DataFrame, by: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """Order-insensitive fingerprint and row count per group.

    The sum is exact in DECIMAL(38,0), so it does not depend on partitioning,
    and partial sums run before the shuffle.
    """
    return df.groupBy(*by).agg(
        F.sum(row_digest(*cols)).cast("decimal(38,0)").cast("string").alias("fingerprint"),
        F.count(F.lit(1)).alias("row_count"),
    )


def registry_changes(registered: DataFrame, current: DataFrame) -> DataFrame:
    """Status per source: new, unchanged, changed or missing."""
    r = registered.select("source_file", F.col("fingerprint").alias("old"))
    c = current.select("source_file", F.col("fingerprint").alias("new"))
    status = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "missing")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("changed")
    )
    return r.join(c, "source_file", "full_outer").select("source_file", status.alias("status"))

"""Global order without a one-task window.

Rows are range-partitioned on the full sort order, sorted inside each
partition and written once with the partition number and the position in it.
The only thing the driver sees is one number per partition; ranks and running
totals are then a map-side addition of that partition's offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.storage import written

PART, POS = "_part", "_pos"
_POSITION_BITS = 33  # monotonically_increasing_id: partition number << 33 | row number


def globally_sorted(df: DataFrame, order: Sequence[Column], label: str = "sorted") -> DataFrame:
    """``df`` with ``_part`` and ``_pos`` such that (_part, _pos) is the order.

    The order must be total (end it with the key): then equal scores spread
    over partitions like any others.
    """
    rid = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rid", rid)
    placed = ranged.withColumn(
        PART, F.shiftright(F.col("_rid"), _POSITION_BITS).cast("int")
    ).withColumn(POS, F.col("_rid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    return written(placed.drop("_rid"), label)


def _with_start(placed: DataFrame, per_part: Sequence[tuple[int, object]], kind: str) -> DataFrame:
    """``placed`` with ``_start``: the exclusive prefix sum of one number per partition."""
    total, rows = 0, []
    for part, amount in sorted(per_part):
        rows.append((part, str(total)))
        total += amount
    starts = placed.sparkSession.createDataFrame(rows, f"{PART} int, _start string")
    # One row per partition.
    return placed.join(F.broadcast(starts.withColumn("_start", F.col("_start").cast(kind))), PART)


def with_rank(placed: DataFrame, name: str = "rank") -> DataFrame:
    """Add ROW_NUMBER over the whole frame produced by :func:`globally_sorted`."""
    counts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()
    started = _with_start(placed, [(r[PART], r["n"]) for r in counts], "bigint")
    return started.select(*placed.columns, (F.col("_start") + F.col(POS) + 1).alias(name))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    return with_rank(globally_sorted(df, order, name), name).drop(PART, POS)


def with_running_total(placed: DataFrame, amount: Column, name: str, kind: str = "bigint") -> DataFrame:
    """Inclusive running total in global order; ``kind`` must be an exact type."""
    summed = placed.groupBy(PART).agg(
        F.coalesce(F.sum(amount.cast(kind)), F.lit(0).cast(kind)).alias("s")
    ).collect()
    started = _with_start(placed, [(r[PART], r["s"]) for r in summed], kind)
    inside = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    return started.select(*placed.columns, (F.col("_start") + F.sum(amount.cast(kind)).over(inside)).cast(kind).alias(name))


BINS = 1024


def first_rows(df: DataFrame, order: Sequence[tuple[Column, bool]], k: int) -> Column:
    """The condition that the first ``k`` rows of ``df`` meet in an order of (finite number, descending) pairs.

    Nothing is sorted or moved. The k-th value is found by counting values in
    bins between the smallest and the largest candidate, and counting again
    inside the bin it lies in, until that holds one value; rows equal to it are
    cut by the next column. A pass sees at most BINS counts. The columns must
    tell all rows apart.
    """
    if k <= 0:
        return F.lit(False)
    before, same = F.lit(False), F.lit(True)
    for column, descending in order:
        v = -column if descending else column
        own = df.filter(same)
        lo, hi, n = own.agg(F.min(v), F.max(v), F.count(v)).first()
        if n <= k:
            return before | same
        while lo != hi and n != k:
            at = ((v - F.lit(lo)).cast("double") / F.lit(float(hi - lo)) * BINS).cast("int")
            bins = own.filter(v.between(lo, hi)).groupBy(F.least(at, F.lit(BINS - 1)).alias("bin")).agg(
                F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
            for b in sorted(bins, key=lambda b: b["bin"]):
                if b["n"] >= k:
                    lo, hi, n = b["lo"], b["hi"], b["n"]
                    break
                k -= b["n"]
        if n == k:
            return before | (same & (v <= F.lit(hi)))
        before, same = before | (same & (v < F.lit(lo))), same & (v == F.lit(lo))
    raise ValueError("the order does not tell all rows apart")


def with_grand_total(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Attach one-row aggregates of ``df`` to all its rows (AGG() OVER ())."""
    one_row = df.agg(*[c.alias(n) for n, c in totals.items()])
    return df.crossJoin(F.broadcast(one_row))


def average_percent_rank(df: DataFrame, value: str, key: Sequence[str], name: str) -> DataFrame:
    """Rank of ``value`` over the row count, ties sharing their average rank.

    NULL values get NULL and are not counted, as in a percent rank over
    present values.
    """
    present = df.filter(F.col(value).isNotNull())
    ranked = global_rank(present.select(value, *key), [F.col(value), *[F.col(k) for k in key]], "_rank")
    n = ranked.count()
    ties = ranked.groupBy(value).agg(
        ((F.min("_rank") + F.max("_rank")) / 2 / F.lit(float(max(n, 1)))).alias(name))
    return df.join(written(ties, "ties"), value, "left").select(*df.columns, name)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Written counts of the distinct values of ``cols``, column ``n``.

    Moments and percentiles of a column can then share one pass over the rows.
    """
    return written(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")), "value_counts")


def exact_percentiles(
    df: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Linear-interpolated percentiles, exact, without a per-group value buffer.

    Equal values collapse to a count first, so a value or group holding most of
    the rows costs one record. Positions are found with a global running total.
    ``weight`` names a column of row counts when ``df`` is already counted.
    """
    by = list(by)
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("_n"))
    placed = globally_sorted(counts, [F.col(c) for c in [*by, value]], "percentile")
    run = with_running_total(placed, F.col("_n"), "_upto").withColumn("_before", F.col("_upto") - F.col("_n"))
    group = run.groupBy(*by).agg(F.sum("_n").alias("_size"), F.min("_before").alias("_start"))
    if by:
        keyed = _null_safe_join(run, group, by)
    else:
        keyed = run.crossJoin(F.broadcast(group))
    first, last = F.col("_before") - F.col("_start"), F.col("_upto") - F.col("_start")
    picks, outs = [], []
    for name, p in fractions.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= pos) & (pos < last), F.col(value))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    found = keyed.groupBy(*by).agg(*picks, F.max("_size").alias("_size"))
    return found.select(*by, *outs)


def _null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    r = right.select(*[F.col(b).alias(f"_r_{b}") for b in by], *[c for c in right.columns if c not in by])
    cond = None
    for b in by:
        c = F.col(b).eqNullSafe(F.col(f"_r_{b}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"_r_{b}" for b in by])

"""Column helpers used across the plans. All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def round_half_up(c: Column, digits: int) -> Column:
    """Rounded to ``digits``, halves away from zero, with plain double operations."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def money(c: Column) -> Column:
    """Half-up to 2 digits with plain double operations."""
    return F.floor(c * 100.0 + 0.5) / 100.0


def four_digits(c: Column) -> Column:
    return F.floor(c * 10000.0 + 0.5) / 10000.0


def share(cond: Column) -> Column:
    """Aggregate: fraction of rows where ``cond`` holds."""
    return F.count_if(cond).cast("double") / F.count(F.lit(1))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0."""
    return F.try_divide(num, den)


def coefficient_of_variation(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, F.try_divide(std, mean))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when either side is constant.

    Built from covariance and deviations: the built-in raises on a constant
    column under ANSI even inside a guard, as aggregates are always evaluated.
    """
    corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), corr)


def right_closed_band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge[i-1], edge[i]]; the last label is open-ended.

    ``len(labels) == len(edges) + 1``. NULL and NaN input give NULL.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("labels must be one longer than edges")
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    band = F.when(~known, F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        band = band.when(value <= edge, label)
    return band.otherwise(labels[-1])


def hash_uniform(salt: str, *keys: Column, seed: int = 42) -> Column:
    """Deterministic draw in [0, 1) per key and salt, independent of partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_order_key(salt: str, *keys: Column, seed: int = 42) -> Column:
    return F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in keys])
    )


def hash_order_numbers(salt: str, *keys: Column, seed: int = 42) -> list[Column]:
    """The same order as numbers: 60, 60 and 8 bits of the key."""
    key = hash_order_key(salt, *keys, seed=seed)
    return [F.conv(F.substring(key, at, n), 16, 10).cast("bigint") for at, n in ((1, 15), (16, 15), (31, 2))]


def row_digest(*cols: Column) -> Column:
    """Order-insensitive summable digest of a row: 48 bits of its md5.

    Fields carry their length and NULL is a mark of its own, so that different rows give different texts.
    """
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))
    text = F.concat_ws("|", *[field(c.cast("string")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")


def is_finite(c: Column) -> Column:
    """NULL is not finite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def iso_weekday(dt: Column) -> Column:
    return F.weekday(dt) + 1


def week_start(dt: Column) -> Column:
    return F.date_trunc("week", dt).cast("date")

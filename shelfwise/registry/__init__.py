"""Named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType

# Only for the comparison of two engines: sums in another order may leave a tie a few ulp to either side.
TIE_SLACK = 0.50001

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits and dates to text, so both engines print the same."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = (F.floor(c * 1e6 + TIE_SLACK) / 1e6).alias(f.name)
        elif isinstance(f.dataType, DateType):
            c = c.cast("string").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from shelfwise.registry import (  # noqa: F401
        analysis_queries,
        check_queries,
        decision_queries,
        feature_queries,
        forecast_queries,
        kpi_queries,
        model_queries,
        scalar_queries,
        source_queries,
        stored_queries,
    )

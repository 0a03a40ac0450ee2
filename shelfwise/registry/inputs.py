"""Common inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans import warehouse
from shelfwise.sources import panel


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.source_rows(spark, sf_dir)


def raw_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.source_rows(spark, sf_dir, hourly=True)


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.staging(raw(spark, sf_dir))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.fact(staging(spark, sf_dir))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).filter(F.col("source_file") == "train.parquet")

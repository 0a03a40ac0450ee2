"""Reading sources and writing layer tables: ingest, registry, snapshots, CSV."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from shelfwise import schemas
from shelfwise.operators import compare, gates
from shelfwise.sources import versions


class DuplicateLoad(RuntimeError):
    """The source file is already in the raw layer."""


class ShortLoad(RuntimeError):
    """The raw layer holds another number of rows than the source."""


class EvaluationChanged(RuntimeError):
    """Another evaluation is stored already."""


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# --- raw layer ---------------------------------------------------------------

def footer_counts(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Row counts, by partition columns if any, from the Parquet footers; no column is read.

    A session of its own, since only the newer reader counts from footers.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def loaded_rows(spark: SparkSession, raw_path: str, source_file: str) -> int:
    """Rows of one source in the raw layer, from the footers of its own partition."""
    folder = f"{raw_path}/source_file={source_file}"
    return footer_counts(spark, folder).first()["rows"] if path_exists(spark, folder) else 0


def already_loaded(spark: SparkSession, raw_path: str, source_file: str, rows: int | None = None) -> bool:
    """Whether the raw layer holds the source; with its registered ``rows``, all of it or none."""
    have = loaded_rows(spark, raw_path, source_file)
    if have and rows is not None and have != rows:
        raise ShortLoad(f"{source_file}: {have} of {rows} rows")
    return have > 0


def ingest(spark: SparkSession, source_path: str, source_file: str, raw_path: str) -> None:
    """Append one source to the raw layer with its name and load time; all its rows must arrive."""
    if already_loaded(spark, raw_path, source_file):
        raise DuplicateLoad(source_file)
    rows = spark.read.schema(schemas.SOURCE_RETAIL_DAILY).parquet(source_path)
    (
        rows.withColumn("source_file", F.lit(source_file))
        .withColumn("ingested_at", F.current_timestamp())
        .write.partitionBy("source_file").mode("append").parquet(raw_path)
    )
    already_loaded(spark, raw_path, source_file, footer_counts(spark, source_path).first()["rows"])


def read_raw(spark: SparkSession, raw_path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_RETAIL_DAILY).parquet(raw_path)


def source_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per source and the column count of a stored layer, from its footers."""
    columns = len(spark.read.parquet(path).columns)
    rows = [(r["source_file"], r["rows"], columns) for r in footer_counts(spark, path, ["source_file"]).collect()]  # sources
    return spark.createDataFrame(rows, "source_file string, rows long, columns int")


def insert_if_absent(new: DataFrame, key: Sequence[str], path: str) -> DataFrame:
    """Append the rows whose key the table at ``path`` lacks, rebuilt by :func:`rebuild` or not; returns the table."""
    spark = new.sparkSession
    held = versions.snapshot(spark, path)
    if held:
        absent = compare.absent_rows(new, held.read("rows", new.schema), key)
        return versions.append(spark, path, "rows", absent).read("rows", new.schema)
    compare.absent_rows(new, spark.read.schema(new.schema).parquet(path), key).write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def rebuild(df: DataFrame, path: str) -> DataFrame:
    """Replace a derived table; readers of the version before keep it, and a lost job leaves it in place."""
    return versions.replace(df.sparkSession, path, {"rows": df}).read("rows", df.schema)


# --- predictions -------------------------------------------------------------

def write_predictions_csv(rows: DataFrame, path: str) -> None:
    rows.select(*[f.name for f in schemas.FORECAST_EVALUATION]).write.option("header", True).csv(path)


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FORECAST_EVALUATION).option("header", True).option(
        "mode", "FAILFAST").csv(path)


STORED_EVALUATION = StructType([*schemas.FORECAST_EVALUATION.fields, StructField("source_print", StringType())])


def load_evaluation(spark: SparkSession, base: str, new: DataFrame, checks: Callable[[DataFrame], DataFrame]) -> str:
    """Load an evaluation once, with the fingerprint of its rows: ``load``, or ``keep`` when it is there already.

    Another evaluation than the stored one is refused, whatever the caller
    wants, and so are rows that fail a check; both leave the stored one as it is.
    """
    # Doubles are compared by their exact bits through their text form.
    cols = [F.col(f.name) for f in schemas.FORECAST_EVALUATION]
    now = compare.table_fingerprint(new, [], cols).first()
    held = versions.snapshot(spark, base)
    if held:
        stored = held.read("evaluation", STORED_EVALUATION).agg(
            F.count(F.lit(1)), F.min("source_print"), F.max("source_print")).first()
        if tuple(stored) != (now["row_count"], now["fingerprint"], now["fingerprint"]):
            raise EvaluationChanged(f"{stored[0]} rows are stored with another fingerprint")
        return "keep"
    rows = new.select(*cols, F.lit(now["fingerprint"]).alias("source_print"))
    versions.replace(spark, base, {"evaluation": rows}, lambda t, _: checks(t["evaluation"].drop("source_print")))
    return "load"


def stored_evaluation(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the loaded evaluation; none before the first load."""
    held = versions.snapshot(spark, base)
    return held.read("evaluation", STORED_EVALUATION) if held else spark.createDataFrame([], STORED_EVALUATION)


# --- forecasts ---------------------------------------------------------------

def append_forecast(forecast: DataFrame, path: str) -> None:
    forecast.write.partitionBy("run_id").mode("append").parquet(path)


def read_forecast(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema(schemas.FORECAST).parquet(path).filter(F.col("run_id") == run_id)


# --- run audit ---------------------------------------------------------------

def latest_state(events: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Newest event per key.

    A maximum of (order, columns) keeps one candidate per key and task before
    the shuffle, so a run with most of the events is no hot group.
    """
    newest = F.max(F.struct(*order, *cols)).alias("e")
    return events.groupBy(*key).agg(newest).select(*key, *[F.col(f"e.{c}").alias(c) for c in (*order, *cols)])


def run_table(events: DataFrame, stage: str = "run") -> DataFrame:
    """One row per run from its own events: start, newest end, settings it started with, status of its last event."""
    ended = F.col("status").isin("success", "failed")
    return events.filter(F.col("stage") == stage).groupBy("run_id").agg(
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"),
        F.max(F.when(F.col("status") == "running", F.struct("ts", "details")))["details"].alias("config"),
        F.max(F.struct("ts", "status"))["status"].alias("status"),
    )


def close_abandoned(state: DataFrame, status: str, running: str, cutoff: str, ts: str = "ts") -> DataFrame:
    """Runs still ``running`` whose last event is older than ``cutoff`` count as failed."""
    late = (F.col(status) == running) & (F.col(ts) < F.lit(cutoff).cast("timestamp"))
    return state.withColumn(status, F.when(late, "failed").otherwise(F.col(status)))


def latest_success(events: DataFrame, status: str, success: str, order: Sequence[str], config: str, field: str) -> DataFrame:
    """The newest successful event and one field of its JSON config."""
    return (
        events.filter(F.col(status) == success).orderBy(*[F.desc(c) for c in order]).limit(1)
        .withColumn(field, F.get_json_object(config, f"$.{field}"))
    )


# --- snapshots ---------------------------------------------------------------

_POINTER = StructType([
    StructField("run_id", StringType()), StructField("published_at", TimestampType()), StructField("folder", StringType())])


def publish(
    spark: SparkSession,
    base: str,
    run_id: str,
    tables: Mapping[str, DataFrame],
    checks: Callable[[dict[str, DataFrame]], DataFrame],
) -> None:
    """Write all tables of a run, check what was written, then move the pointer.

    The pointer is one appended row. Until it is committed, readers resolve
    the previous run, so a failed gate or a lost job leaves the old snapshot.
    Every attempt has its own folder, so a run can be tried again.
    """
    stored, folder = {}, f"{base}/run_id={run_id}/attempt={uuid.uuid4().hex}"
    for name, df in tables.items():
        path = f"{folder}/{name}"
        df.write.mode("errorifexists").parquet(path)
        stored[name] = spark.read.schema(df.schema).parquet(path)
    gates.require(checks(stored))
    row = spark.createDataFrame([(run_id, datetime.now(timezone.utc), folder)], _POINTER)
    row.write.mode("append").parquet(f"{base}/_published")


def _pointer(spark: SparkSession, base: str):
    if not path_exists(spark, f"{base}/_published"):
        return None
    runs = spark.read.schema(_POINTER).parquet(f"{base}/_published")
    return runs.agg(F.max(F.struct("published_at", "run_id", "folder")).alias("r")).first()["r"]


def current_run(spark: SparkSession, base: str) -> str | None:
    row = _pointer(spark, base)
    return row["run_id"] if row else None


def current_folder(spark: SparkSession, base: str) -> str | None:
    """Where the published attempt of the current run lies."""
    row = _pointer(spark, base)
    return row["folder"] if row else None


def read_published(spark: SparkSession, base: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{current_folder(spark, base)}/{name}")

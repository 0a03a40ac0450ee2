"""Written intermediate tables in the cluster's shared folder.

A plan that is read several times, or whose rows must not move between two
jobs, is written once as Parquet and read back. This cuts lineage, survives
executor loss, and gives the planner real file sizes, so later joins broadcast
a side only when its measured size is under the threshold.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    # One machine only: local, local[8] and the like, not local-cluster.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="shelfwise-")
    return _OWN_DIRS[app]


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete the intermediate tables this application wrote; call it when done."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Delete written tables, given as scans of them, that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        own = f"/tables/{spark.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if own in folder:  # never anything but an intermediate table of this application
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

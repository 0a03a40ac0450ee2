"""Tables stored in buckets of a key, so that joins, groups and windows by that key move no row.

A bucket is one sorted file: the rows of a key lie together. The number of
buckets follows the bytes of the rows as a task reads them, which
compressed files do not tell, and is a power of two, so that tables of
different size still meet bucket by bucket (with
``spark.sql.bucketing.coalesceBucketsInJoin.enabled``, up to four times as
many). Keys must not be hot; a series has at most one row a day.

Any session that knows the folder can read it: the layout is stored with the
files, written last, so a table without one was not finished and is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.tables import path_exists

BUCKET_BYTES = 256 * 1024 * 1024


class Unfinished(RuntimeError):
    """The table has no layout: the job that wrote it was lost, or it is no bucketed table."""


def buckets_for(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Smallest power of two that keeps a bucket at ``bucket_bytes``."""
    return 1 << max(0, -(-total_bytes // bucket_bytes) - 1).bit_length()


def row_bytes(df: DataFrame) -> int:
    """Bytes of all rows of a written table outside its files: their number by the width of the columns."""
    return df.count() * df._jdf.schema().defaultSize()


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` scans."""
    spark = df.sparkSession
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def _name(path: str) -> str:
    return "bucketed_" + hashlib.sha1(path.encode()).hexdigest()


def write(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = (), buckets: int = 1) -> None:
    """Store ``df`` at the new folder ``path`` in ``buckets`` files by ``key``, sorted by key and ``order``."""
    if buckets < 1 or not key:
        raise ValueError("a bucketed table needs a key and at least one bucket")
    if path_exists(df.sparkSession, path):
        raise ValueError(f"{path} exists already")
    # Rows go to the task of their bucket first, so there is one file for each, however many tasks made them.
    rows = df.repartition(buckets, *key)
    rows.write.format("parquet").bucketBy(buckets, *key).sortBy(*key, *order).option("path", path).saveAsTable(_name(path))
    layout = json.dumps({"key": list(key), "order": list(order), "buckets": buckets,
                         "columns": [[f.name, f.dataType.simpleString()] for f in df.schema]})
    df.sparkSession.createDataFrame([(layout,)], "layout string").coalesce(1).write.text(f"{path}/_layout")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a stored table that knows its buckets."""
    rows = spark.read.text(f"{path}/_layout").take(1) if path_exists(spark, f"{path}/_layout") else []
    if not rows:
        raise Unfinished(path)
    layout = json.loads(rows[0]["value"])

    def names(columns):
        return ", ".join(f"`{c}`" for c in columns)

    columns = ", ".join(f"`{n}` {kind}" for n, kind in layout["columns"])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({columns}) USING parquet CLUSTERED BY ({names(layout['key'])}) "
        f"SORTED BY ({names([*layout['key'], *layout['order']])}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(_name(path))

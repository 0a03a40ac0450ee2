"""Tables replaced and corrected version by version.

    <base>/data/<id>/part-*      the files of one write
    <base>/lists/<id>/           which files make up a version: rows (table, file)
    <base>/versions/0000000007   one line, the list of that version

A writer stores its files, then their list, and claims the next number last by
creating its file, which fails when another writer was first. Until then readers
see the version before, and a reader keeps the files of the version it opened,
so a lost job or a failed check changes nothing. Several tables are replaced in
one step. An update rewrites only files that hold a row it changes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators import gates

GATES = "gates"
# A claim without its line belongs to a writer at work for so long, to a lost one after that.
CLAIM_SECONDS = 600
Checks = Callable[[dict[str, DataFrame], dict[str, dict]], DataFrame]


class VersionConflict(RuntimeError):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Snapshot:
    """One version: its number and the files of every table."""

    spark: SparkSession
    base: str
    number: int
    files: Mapping[str, tuple[str, ...]]

    def read(self, table: str, schema: StructType) -> DataFrame:
        files = self.files[table]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, folder: str) -> list:
    fs, p = _at(spark, folder)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _data_files(spark: SparkSession, folder: str) -> tuple[str, ...]:
    found = [(f.getPath().getName(), f.getPath().toString()) for f in _listed(spark, folder) if f.isFile()]
    return tuple(sorted(path for name, path in found if not name.startswith(("_", "."))))


def numbers(spark: SparkSession, base: str) -> list[int]:
    """All versions; a claim whose writer was lost before its line was written is none."""
    return sorted(int(f.getPath().getName()) for f in _listed(spark, f"{base}/versions") if f.getLen() and f.getPath().getName().isdigit())


def snapshot(spark: SparkSession, base: str, number: int | None = None) -> Snapshot | None:
    """Version ``number``, or the newest; None before the first one."""
    have = numbers(spark, base)
    if number is None and not have:
        return None
    number = have[-1] if number is None else number
    folder = spark.read.text(f"{base}/versions/{number:010d}").first()[0]
    files: dict[str, list[str]] = {}
    for r in spark.read.parquet(folder).collect():  # one row per file, as a file listing has
        files.setdefault(r["table"], [])
        if r["file"] is not None:
            files[r["table"]].append(r["file"])
    return Snapshot(spark, base, number, {t: tuple(sorted(f)) for t, f in files.items()})


def _claim(spark: SparkSession, path: str, line: str) -> None:
    fs, p = _at(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            raise VersionConflict(path) from e
        raise
    out.write(bytearray(line.encode()))
    out.close()


def _commit(spark: SparkSession, base: str, held: Snapshot | None, files: Mapping[str, tuple[str, ...]]) -> Snapshot:
    folder = f"{base}/lists/{uuid.uuid4().hex}"
    rows = [(t, f) for t, own in files.items() for f in own or (None,)]
    spark.createDataFrame(rows, "`table` string, file string").coalesce(1).write.parquet(folder)
    claims = {int(f.getPath().getName()): f for f in _listed(spark, f"{base}/versions") if f.getPath().getName().isdigit()}
    newest = max([n for n, f in claims.items() if f.getLen()], default=None)
    made_now = [f for f in claims.values() if not f.getLen() and f.getModificationTime() > 1000 * (time.time() - CLAIM_SECONDS)]
    if newest != (held.number if held else None) or made_now:
        raise VersionConflict(base)
    number = max(claims, default=0) + 1
    _claim(spark, f"{base}/versions/{number:010d}", folder)
    return Snapshot(spark, base, number, dict(files))


def _store(df: DataFrame, base: str, watch: Mapping[str, Column] | None = None) -> tuple[tuple[str, ...], dict]:
    """Write a table once; what is watched is counted while it is written."""
    spark, folder, seen = df.sparkSession, f"{base}/data/{uuid.uuid4().hex}", None
    if watch:
        seen = Observation()
        df = df.observe(seen, *[c.alias(n) for n, c in watch.items()])
    df.write.mode("errorifexists").parquet(folder)
    return _data_files(spark, folder), seen.get if seen else {}


def replace(
    spark: SparkSession,
    base: str,
    tables: Mapping[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]],
    checks: Checks | None = None,
    watched: Mapping[str, Mapping[str, Column]] | None = None,
) -> Snapshot:
    """A version in which ``tables`` have new rows and all others those of the version before.

    A table may be a function of the stored ones before it. ``checks`` gets the
    stored tables and what was ``watched``; its rows are stored as table
    ``gates``, and the version is made only if all of them are ok.
    """
    held = snapshot(spark, base)
    files = dict(held.files) if held else {}
    stored: dict[str, DataFrame] = {}
    seen: dict[str, dict] = {}
    for name, made in tables.items():
        df = made(stored) if callable(made) else made
        files[name], seen[name] = _store(df, base, (watched or {}).get(name))
        stored[name] = Snapshot(spark, base, 0, files).read(name, df.schema)
    if checks:
        result = checks(stored, seen)
        files[GATES], _ = _store(result, base)
        gates.require(Snapshot(spark, base, 0, files).read(GATES, result.schema))
    return _commit(spark, base, held, files)


def append(spark: SparkSession, base: str, table: str, df: DataFrame) -> Snapshot:
    """A version in which ``table`` has the rows of ``df`` besides those it had; its files stay as they are."""
    held = snapshot(spark, base)
    have = dict(held.files) if held else {}
    more, _ = _store(df, base)
    return _commit(spark, base, held, have | {table: (*have.get(table, ()), *more)})


def _name(file: str) -> str:
    return "/".join(file.split("/")[-2:])


def update(
    spark: SparkSession, base: str, table: str, schema: StructType, where: Column, changes: Mapping[str, Column]
) -> Snapshot:
    """A version in which rows ``where`` have the ``changes``; files without such a row stay as they are.

    Returns the present version when there is nothing to change.
    """
    held = snapshot(spark, base)
    if held is None:
        raise ValueError(f"no version at {base}")
    hit = F.coalesce(where, F.lit(False))
    found = held.read(table, schema).filter(hit).select(F.col("_metadata.file_path").alias("file")).distinct().collect()
    names = {_name(r["file"]) for r in found}  # files, as in the list
    touched = tuple(f for f in held.files[table] if _name(f) in names)
    if not touched:
        return held
    rows = Snapshot(spark, base, 0, {table: touched}).read(table, schema)
    rewritten, _ = _store(rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}), base)
    files = dict(held.files) | {table: tuple(sorted({*held.files[table]} - {*touched} | {*rewritten}))}
    return _commit(spark, base, held, files)

"""Contiguous shards of near equal bytes from global prefix sums.

Rows are range-partitioned and sorted by the order, and every partition notes
its running bytes and row numbers as it is written. One total per partition
gives the offsets of the next ones; a row belongs to the shard in whose equal
share of all bytes its middle byte lies. Shards are contiguous in the order,
and their sizes differ from the mean by less than the largest row.

Null ids come first; equal ids are ordered by their text's hash, and rows equal
in both take any order, which moves nothing but equal rows. Null text counts as
no bytes. Input columns named like a result column are replaced by it.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from shelfwise.llm.columns import aside, back
from shelfwise.sources.storage import dropped, written

ROW_BYTES = 16


def document_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes before and number of each row within its partition."""
    size_sum = rows = 0
    for b in batches:
        size = b.column("__size").to_numpy()
        before = size_sum + np.cumsum(size) - size
        number = rows + np.arange(len(size), dtype=np.int64)
        yield b.append_column("__before", pa.array(before, pa.int64())).append_column("__row", pa.array(number, pa.int64()))
        size_sum, rows = size_sum + int(size.sum()), rows + len(size)


def contiguous_shards(documents: DataFrame, shards: int, size: Column, order: list[Column]) -> DataFrame:
    """``documents`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within it)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = documents.sparkSession
    sized = documents.withColumn("__size", size).drop("shard", "slot")
    # Rows equal in the whole order still spread over partitions.
    ordered = sized.withColumn("__tie", F.monotonically_increasing_id())
    placed = ordered.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie").withColumn(
        "__part", F.spark_partition_id())
    schema = StructType([*placed.schema.fields, StructField("__before", LongType()), StructField("__row", LongType())])
    placed = written(placed.mapInArrow(_running, schema), "placed")
    totals = placed.groupBy("__part").agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    offsets, total, rows = [], 0, 0
    for r in sorted(totals, key=lambda r: r["__part"]):  # one row per partition
        offsets.append((r["__part"], total, rows))
        total, rows = total + r["s"], rows + r["n"]
    starts = spark.createDataFrame(offsets, StructType([
        StructField("__part", IntegerType()), StructField("__bytes", LongType()), StructField("__rows", LongType())]))
    middle = 2 * (F.col("__bytes") + F.col("__before")) + F.col("__size")
    cut = F.expr(f"int(least({shards - 1}, (__middle * {shards}) div {max(2 * total, 1)}))")
    dealt = placed.join(F.broadcast(starts), "__part").withColumn("__middle", middle).withColumn("shard", cut).withColumn(
        "__at", F.col("__rows") + F.col("__row"))
    first = dealt.groupBy("shard").agg(F.min("__at").alias("__first"))  # as many rows as shards
    out = dealt.join(F.broadcast(first), "shard").withColumn("slot", F.col("__at") - F.col("__first"))
    return out.select(*sized.drop("__size").columns, "shard", "slot")


# Bytes of documents that are sorted in one task.
PIECE_BYTES = 64 << 20


def _key(doc_id, text: int, row: int) -> tuple:
    return doc_id is not None, 0 if doc_id is None else doc_id, text, row


def _placer(bounds: list[tuple]):
    """The piece of a row: the number of bounds below its key."""
    def place(doc_id: pa.Array, text: pa.Array, row: pa.Array) -> pa.Array:
        keys = map(_key, doc_id.to_pylist(), text.to_pylist(), row.to_pylist())
        return pa.array([bisect_left(bounds, k) for k in keys], pa.int32())

    return F.arrow_udf(place, "int")


def _dealer(starts: list[tuple[int, int]], first: dict[int, int], total: int, shards: int):
    """Adds shard and slot to the sorted rows of a piece, which starts after so many bytes and rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            if before is None:
                before, number = starts[b.column("piece")[0].as_py()]
            size = b.column("size").to_numpy()
            middle = 2 * (before + np.cumsum(size) - size) + size
            shard = np.minimum(middle * shards // max(2 * total, 1), shards - 1)
            base = np.array([first.get(s, 0) for s in range(shards)])[shard]
            slot = number + np.arange(len(size), dtype=np.int64) - base
            before, number = before + int(size.sum()), number + len(size)
            yield b.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))

    return run


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """``documents`` (doc_id, text, ...) in ascending doc_id, cut into near equal bytes.

    Only ids, hashes and sizes are sorted to find where pieces and shards begin;
    the documents are then moved once, to their piece. Rows equal in id and text
    are ordered by a hash of their other columns; only rows equal in all of them
    are kept in one piece.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark, used = documents.sparkSession, ["doc_id", "text"]
    docs = aside(documents, used)
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    docs = docs.withColumns({"size": document_size(), "t": F.xxhash64("text"), "r": F.xxhash64(*hashed)})
    order = [F.col("doc_id").asc_nulls_first(), F.col("t"), F.col("r")]
    narrow = docs.select("doc_id", "t", "r", F.col("size").alias("__size"))
    total = narrow.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PIECE_BYTES))
    ranged = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields, StructField("__before", LongType()), StructField("__row", LongType())])
    placed = written(ranged.mapInArrow(_running, schema), "placed")
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "t", "r")).alias("last")
    found = placed.groupBy("__part").agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n"), last).collect()  # one row per piece
    starts, bounds, offsets, size, rows = [], [], [], 0, 0
    for r in sorted(found, key=lambda r: r["__part"]):
        starts.append((size, rows))
        offsets.append((r["__part"], size, rows))
        bounds.append(_key(r["last"]["doc_id"], r["last"]["t"], r["last"]["r"]))
        size, rows = size + r["s"], rows + r["n"]
    begin = spark.createDataFrame(offsets, "__part int, __bytes long, __rows long")
    cut = F.expr(f"int(least({shards - 1}, ((2 * (__bytes + __before) + __size) * {shards}) div {max(2 * total, 1)}))")
    dealt = placed.join(F.broadcast(begin), "__part").groupBy(cut.alias("shard")).agg(F.min(F.col("__rows") + F.col("__row")).alias("first"))
    first = {r["shard"]: r["first"] for r in dealt.collect()}  # one row per shard
    dropped(placed)
    piece = _placer(bounds)(F.col("doc_id"), F.col("t"), F.col("r"))
    moved = docs.withColumn("piece", piece).repartitionById(max(len(bounds), 1), "piece").sortWithinPartitions(*order)
    schema = StructType([*moved.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    out = moved.mapInArrow(_dealer(starts, first, total, shards), schema)
    return out.select(*back(documents, used, ("shard", "slot")), "shard", "slot")

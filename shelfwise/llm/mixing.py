"""Mixing sources to target weights by repetition rates.

The words of every source are summed; targets share all words by weight, and a
target stops at CAP times its source's words, the rest being reshared by weight
until none is above. Those targets are min(CAP * words, level * weight) for the
one level at which they add up to all words; the sources that stop are found
with running totals in the order of words / weight, without any loop.

The rate of a source is target / words. A document is taken floor(rate) times,
and once more if its hash, a number in [0, 1) of the seed, its id and its text,
is below the fraction. Reruns agree, and no document is taken more than CAP
times. DataFrame functions only.

Sources rank by code point, null last, and null is a source of its own. Null
and empty texts have no words and take none. Repeated rows share their fate.
Input columns named like a result column are replaced by it. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.columns import aside, back
from shelfwise.operators.ordered import global_rank, globally_sorted, with_running_total
from shelfwise.sources.storage import written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int = SEED) -> Column:
    """A hash of the document in [0, 1), 52 bits of it."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source of ``sized`` (source, size): source, source_size, target."""
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * cap)
    placed = globally_sorted(weighed, [(F.col("source_size") / F.col("_w")).asc(), F.col("_rank").asc()], "targets")
    run = with_running_total(with_running_total(placed, F.col("_cap"), "_caps"), F.col("_w"), "_ws")
    every = sums.agg(F.sum("source_size").alias("_all")).crossJoin(placed.agg(F.sum("_w").alias("_weights")))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    stops = big("_caps") * big("_w") + big("_cap") * (big("_weights") - big("_ws")) <= big("_all") * big("_w")
    judged = written(run.crossJoin(F.broadcast(every)).withColumn("_stops", stops), "judged")
    level = judged.agg(
        F.try_divide(
            (F.max("_all") - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))), F.lit(0))).cast("double"),
            (F.max("_weights") - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_w"))), F.lit(0))).cast("double"),
        ).alias("_level"))
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.coalesce("_level", F.lit(0.0)) * F.col("_w")))
    return judged.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def with_copies(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``documents`` (doc_id, text, source, ...) with size, source_size, target and copies."""
    docs = documents.drop("size", "source_size", "target", "copies").withColumn("size", word_count())
    targets = written(source_targets(docs.select("source", "size"), weights, cap), "rates").withColumnRenamed("source", "_source")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor("_rate").cast("int")
    copies = whole + F.when(draw(seed) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    rated = docs.join(targets.withColumn("_rate", rate), F.col("source").eqNullSafe(F.col("_source")))
    return rated.withColumn("copies", copies).drop("_source", "_rate")


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Every document as often as the mix takes it, with the columns it came with, whatever they are called."""
    used = ["doc_id", "text", "source"]
    taken = with_copies(aside(documents, used), weights, cap, seed).filter("copies > 0")
    repeated = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*back(documents, used))

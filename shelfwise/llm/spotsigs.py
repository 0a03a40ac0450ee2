"""Document fingerprints from spot signatures.

A common word is an anchor; the CHAIN content words that follow it form, with
it, a spot signature. The set of a text's signatures is its fingerprint, and
fingerprints are compared by Jaccard similarity. Sets are partitioned by their
size: two sets whose sizes differ too much cannot be similar, so only the same
and the next partition can hold a partner, and a comparison stops as soon as
the sizes or the signatures seen so far rule the threshold out.

``near_sets`` finds every pair of sets at a threshold or more, wherever their
documents stand. Equal sets are one set with a member per document. A set's
signatures are ordered by how many sets hold them, rarest first; two sets at
the threshold share one of the first (1 - threshold) parts of both, so only
those are joined, within a partition and with the next one. The sets of a
signature that many hold are dealt into a grid of cells, each a key of its own.
No signature and no pair is left out. The number of pairs is that of the result
and of the sets that share a rare signature.

A text without any signature (no common words, or too few words after them)
takes every word as an anchor; then a fingerprint is empty only without
words. A fingerprint is the sorted 32-bit signatures in hex; equal texts have
equal ones. Two empty fingerprints are alike. Null text is empty text.

``edited_neighbours`` needs documents in the order of their ids; null ids come
first, rows with equal ids are ordered by the hash of their text, and each row
is a document of its own. Each range of ids is one block, read in order as a
stream, that also gets the first row of the next block. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.sources.storage import written

CHAIN = 3
# Signatures of a set looked at before the bound is tried again; sets of a signature, and partners of a set, in one cell.
STEP = 64
CELL = 256
# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der des die ein eine er es im ist mit nicht sich sie und von zu "
    "au aux avec ce dans du elle en est et il la le les ne pas pour que qui sur un une "
    "como con del el las los no para por se su una y"
).split()
_ANCHORS = np.sort(words.words_of(pa.array([" ".join(ANCHORS)]), words.ALNUM).hashes())


def signatures(column: pa.Array) -> list[np.ndarray]:
    """Per text its sorted distinct spot signatures."""
    w = words.words_of(column, words.ALNUM)
    h = w.hashes()
    anchor = np.isin(h, _ANCHORS)
    content = np.flatnonzero(~anchor)
    chains = words.ngrams(h[content], CHAIN)
    at = np.flatnonzero(anchor)
    nxt = np.searchsorted(content, at)
    whole = nxt + CHAIN <= len(content)
    at, nxt = at[whole], nxt[whole]
    inside = w.doc[content[nxt + CHAIN - 1]] == w.doc[at] if len(at) else np.zeros(0, dtype=bool)
    at, nxt = at[inside], nxt[inside]
    sig = (words.mix(chains[nxt] + h[at]) >> np.uint64(32)).astype(np.uint32)
    first = np.searchsorted(at, w.first)
    out = []
    for i in range(len(column)):
        own = sig[first[i]:first[i + 1]]
        if not len(own) and w.count[i]:
            ws = h[w.first[i]:w.first[i + 1]]
            own = (words.ngrams(ws, min(CHAIN, len(ws)), salt=3) >> np.uint64(32)).astype(np.uint32)
        out.append(np.unique(own))
    return out


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets, or 0 where it is below ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) == 0:
        return 1.0
    if len(a) == 0 or len(a) / len(b) < least:
        return 0.0
    step = STEP if least > 0 else len(a)
    both = 0
    for i in range(0, len(a), step):
        part = a[i:i + step]
        at = np.searchsorted(b, part)
        both += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        most = both + min(len(a) - i - len(part), len(b) - int(np.searchsorted(b, part[-1], side="right")))
        if most / (len(a) + len(b) - most) < least:
            return 0.0
    return both / (len(a) + len(b) - both)


def length_partition(sizes, least: float):
    """Partitions of set sizes such that partners at ``least`` or more are in the same or a neighbouring one."""
    return np.floor(np.log(np.maximum(sizes, 1)) / -np.log(least) + 1e-9).astype(np.int64)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(ids, texts, following texts) in blocks; rows come sorted by (block, peek, order)."""
    ids, texts, after, size = [], [], [], 0
    last = None  # (block, doc_id, text) that waits for its follower
    for b in batches:
        for block, peek, doc, text in zip(*[b.column(c) for c in ("block", "peek", "doc_id", "text")]):
            block, peek, doc, text = block.as_py(), peek.as_py(), doc.as_py(), text.as_py() or ""
            if last is not None and last[0] == block:
                ids.append(last[1]), texts.append(last[2]), after.append(text)
                size += len(last[2])
            last = None if peek else (block, doc, text)
            if size > words.BLOCK_BYTES // 2:
                yield ids, texts, after
                ids, texts, after, size = [], [], [], 0
    if ids:
        yield ids, texts, after


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None
    for ids, texts, after in _pairs(batches):
        changed = [edited(t, f) for t, f in zip(texts, after)]
        # Followers are mostly the texts of the next row; the last one, and those across blocks, are added.
        own, new = signatures(pa.array(texts, pa.string())), signatures(pa.array(changed, pa.string()))
        odd = [i for i in range(len(texts)) if i + 1 == len(texts) or after[i] is not texts[i + 1]]
        extra = dict(zip(odd, signatures(pa.array([after[i] for i in odd], pa.string()))))
        follow = [extra[i] if i in extra else own[i + 1] for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([fingerprint(s) for s in own]), pa.array([fingerprint(s) for s in new]),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, follow)], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_neighbours(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next document's."""
    spark = documents.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = documents.select(F.col("doc_id").cast("long"), "text", order.alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = docs.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("k"))
    bounds = np.array(sorted(r["k"] for r in starts.collect()), dtype=np.int64)  # one id per partition

    @F.pandas_udf("int")
    def block_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right") - 1).astype("int32")

    n = max(len(bounds), 1)
    block = docs.withColumn("block", block_of("key"))
    is_start = F.col("key").isin([int(x) for x in bounds]) if n <= 1000 else F.col("key") == F.get(F.lit(bounds.tolist()), "block")
    before = F.pmod(F.col("block") - 1, F.lit(n))
    place = lambda b, peek: F.struct(b.alias("block"), F.lit(peek).alias("peek"))
    to = F.when(is_start, F.array(place(F.col("block"), False), place(before, True))).otherwise(F.array(place(F.col("block"), False)))
    dealt = block.select("doc_id", "text", "key", F.explode(to).alias("to")).select("doc_id", "text", "key", "to.block", "to.peek")
    ordered = dealt.repartition(parts, "block").sortWithinPartitions("block", "peek", "key", F.xxhash64("text"))
    return ordered.select("block", "peek", "doc_id", "text").mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _set_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.blocks(batches):
            sets = signatures(b.column("text"))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            # A set's id: a sum of mixed hashes, and of its size.
            ids = np.array([words.mix(words.mix(s.astype(np.uint64) + np.uint64(0x5E7)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0]
                            for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(ids.view(np.int64)), pa.array(sizes), pa.array(length_partition(sizes, least)),
                words.list_array(words.flat(sets, np.uint32)[0].view(np.int32), sizes),
            ], ["doc_id", "set", "n", "part", "sigs"])

    return run


def _verified(least: float):
    """Rows sorted by (a, chunk, role): the set a first, then its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = None, None
        for batch in batches:
            sigs = batch.column("sigs")
            values, ends = sigs.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(sigs.value_lengths().to_numpy())])
            found = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                other = values[ends[i]:ends[i + 1]]
                if a == b:
                    first, own = a, other.copy()
                elif a == first:
                    near = likeness(own, other, least)
                    if near > 0:
                        found.append((a, b, near))
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.float64())], ["a", "b", "near"])

    return run


def _candidates(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of sets that the sizes and the order of their signatures do not rule out."""
    spread = sets.select("set", F.explode("sigs").alias("sig"))
    held = written(spread.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "signatures")
    ordered = spread.join(held, "sig").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("c", "sig"))).alias("by_c"))
    prefix = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    entries = ordered.join(sets.select("set", "n", "part"), "set").select(
        "set", "n", "part", F.posexplode(F.slice("by_c", F.lit(1), prefix.cast("int"))).alias("pos", "e"))
    entries = written(entries.filter("e.c > 1").select("set", "n", "part", F.col("e.sig").alias("sig"), (F.col("n") - F.col("pos")).alias("left")), "entries")
    # The smaller partition's sets also meet those of the next one.
    lower = entries.select("*", F.explode(F.array("part", F.col("part") + 1)).alias("key"))
    grid = lower.groupBy("key", "sig").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells")).filter("cells > 1")
    grid = written(grid, "grid")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        cells = F.coalesce("cells", F.lit(1))
        return side.join(grid, ["key", "sig"], "left").select(
            "key", "sig", "set", "n", "part", "left", F.pmod(F.xxhash64("set"), cells).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias(other))

    x = dealt(lower, "row", "col").alias("x")
    y = dealt(entries.withColumn("key", F.col("part")), "col", "row").alias("y")
    pairs = x.join(y, ["key", "sig", "row", "col"]).filter((F.col("x.part") < F.col("y.part")) | (F.col("x.set") < F.col("y.set")))
    most = F.least("x.left", "y.left")  # for the first signature that both hold
    bound = most / (F.col("x.n") + F.col("y.n") - most)
    pairs = pairs.filter((F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= least) & (bound >= least))
    return pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()


def near_sets(documents: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """All documents whose signature sets have a Jaccard similarity of ``least`` or more.

    The members (doc_id, set, n), a row per document, and the pairs (a, b, near)
    of different sets, a < b, each once. Documents of one set are alike; so are
    those without words, whose set has n = 0.
    """
    if not 0 < least < 1:
        raise ValueError("least must be between 0 and 1")
    kind = dict(documents.dtypes)["doc_id"]
    rows = written(documents.select("doc_id", "text").mapInArrow(
        _set_batches(least), f"doc_id {kind}, set long, n long, part long, sigs array<int>"), "members")
    sets = written(rows.filter("n > 0").groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "part", "sigs")]), "sets")
    pairs = written(_candidates(sets, least), "pairs")
    chunks = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("chunks")), "chunks")
    partners = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), "b")
    firsts = chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("b"))
    asked = partners.unionByName(firsts).join(sets.select(F.col("set").alias("b"), "sigs"), "b")
    ordered = asked.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("b"))
    near = ordered.select("a", "b", "sigs").mapInArrow(_verified(least), "a long, b long, near double")
    return rows.select("doc_id", "set", "n"), written(near, "near")

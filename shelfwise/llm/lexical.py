"""Ranked lexical search over an index stratified by document length.

Index. The normaliser m of a document depends on its length alone, so documents
of equal m form a stratum. A stratum is cut into pieces of bounded documents
and bytes by a hash of the row; a piece is one row of the written index: its
ids, its terms, for every term its frequencies tf in ascending order, and for
every (term, tf) the documents that hold the term so often.

Scores. Within a stratum a term's contribution depends on tf alone, so impacts
are computed once for each tf. The largest tf of its terms bounds what a piece
can give a query. Every query visits pieces by descending bound and stops where
the bound is below the k-th best score so far. A first visit of each task's
best piece alone gives every query a score that k documents have reached; the
second one starts from it. No document that belongs to the result is skipped.

Queries come in blocks of bounded words, each collected, broadcast and released
before the next. Terms are told apart by 64-bit hashes.

Null and empty texts have no term: they are in no stratum and never found, and
as items they find nothing. Null ids are found like others and rank after them
in ties; rows with equal ids are documents of their own. Equal scores rank by
ascending doc_id; repeated items are answered once, items that share only the
id each. A text longer than a piece is a piece of its own. Other columns are
not read, so their names cannot clash. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.sources.storage import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
PIECE_DOCS, PIECE_BYTES = 4096, 1 << 20
PARTITION_BYTES = 32 << 20
BLOCK_WORDS = 200_000
# Different lengths that are broadcast at most; more are joined by shuffle.
BROADCAST_LENGTHS = 500_000


@dataclass(frozen=True)
class Index:
    """The written pieces, the number of documents with a term and of their terms."""

    pieces: DataFrame
    documents: int
    terms: int


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All integers of the ranges, end to end."""
    n = stop - start
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(start - np.cumsum(n) + n, n)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a new value begins, and the length."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))


_COLUMNS = ["m", "ids", "terms", "term_at", "tfs", "entry_at", "docs"]


def _piece(m: int, ids: list[pa.Array], slots: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """One row of the index from the words of its documents."""
    ids = pa.concat_arrays(ids)
    n, h = len(ids), np.concatenate(hashes)
    terms = np.unique(h)
    words_at = np.sort(np.searchsorted(terms, h) * n + np.concatenate(slots))
    first = _changes(words_at)
    tf = np.diff(first)
    term, slot = np.divmod(words_at[first[:-1]], n)
    width = int(tf.max()) + 1
    entry, docs = np.divmod(np.sort((term * width + tf) * n + slot), n)
    entry_at = _changes(entry)
    term, tfs = np.divmod(entry[entry_at[:-1]], width)
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays([
        pa.array([m], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), one(terms.view(np.int64), pa.int64()),
        one(_changes(term), pa.int32()), one(tfs, pa.int32()), one(entry_at, pa.int32()), one(docs, pa.int32())], _COLUMNS)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m, piece) to rows of the index."""
    key, ids, slots, hashes, count, held = None, [], [], [], 0, 0
    for b in words.blocks(batches):
        w = words.words_of(b.column("text"), words.ALNUM)
        h = w.hashes()
        m, part = b.column("m").to_numpy(), b.column("piece").to_numpy()
        cuts = np.flatnonzero((m[1:] != m[:-1]) | (part[1:] != part[:-1])) + 1
        for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
            if ids and (key != (m[a], part[a]) or count >= PIECE_DOCS or held >= PIECE_BYTES):
                yield _piece(int(key[0]), ids, slots, hashes)
                ids, slots, hashes, count, held = [], [], [], 0, 0
            key = m[a], part[a]
            mine = slice(w.first[a], w.first[z])
            ids.append(b.column("doc_id").slice(a, z - a))
            slots.append(w.doc[mine] - a + count)
            hashes.append(h[mine])
            count, held = count + int(z - a), held + int(w.offsets[z] - w.offsets[a])
    if ids:
        yield _piece(int(key[0]), ids, slots, hashes)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, rows, bytes) of the texts with n terms, summed over a block."""
    for b in words.blocks(batches):
        w = words.words_of(b.column("text"), words.ALNUM)
        n, at, rows = np.unique(w.count, return_inverse=True, return_counts=True)
        size = np.bincount(at, np.diff(w.offsets).astype(np.float64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(rows), pa.array(size)], ["n", "rows", "bytes"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their number of terms."""
    for b in words.blocks(batches):
        yield b.append_column("n", pa.array(words.words_of(b.column("text"), words.ALNUM).count))


def build(documents: DataFrame) -> Index:
    """The index of all rows of ``documents`` (doc_id, text) that have a term."""
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"m long, ids array<{kind}>, terms array<long>, term_at array<int>, tfs array<int>, entry_at array<int>, docs array<int>"
    docs = documents.select("doc_id", "text")
    each = docs.select("text").mapInArrow(_lengths, "n long, rows long, bytes long").filter("n > 0")
    lengths = written(each.groupBy("n").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")), "lengths")
    found = lengths.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("n")), F.sum("bytes"), F.count(F.lit(1))).first()
    if not found[0]:
        return Index(spark.createDataFrame([], schema), 0, 0)
    by_m = lengths.withColumn("m", F.expr(f"100 - 75 + (75 * n * {found[0]}L) div {found[1]}L"))
    pieces = by_m.groupBy("m").agg(
        F.greatest(F.ceil(F.sum("rows") / PIECE_DOCS), F.ceil(F.sum("bytes") / PIECE_BYTES)).alias("pieces"))
    strata = written(by_m.join(pieces, "m").select("n", "m", "pieces"), "strata")
    if found[3] <= BROADCAST_LENGTHS:
        strata = F.broadcast(strata)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found[2] // PARTITION_BYTES))
    dealt = docs.mapInArrow(_counted, f"doc_id {kind}, text string, n long").join(strata, "n").withColumn("piece", F.pmod(F.xxhash64("doc_id", "text"), "pieces"))
    ordered = dealt.select("m", "piece", "doc_id", "text").repartition(parts, "m", "piece").sortWithinPartitions("m", "piece")
    return Index(written(ordered.mapInArrow(_pieces, schema), "index"), found[0], found[1])


class Asked:
    """The terms of a block of queries, and for every term the queries that hold it and how often."""

    def __init__(self, texts: list[str]):
        w = words.words_of(pa.array(texts, pa.string()), words.ALNUM)
        self.n = len(texts)
        self.terms, at = np.unique(w.hashes(), return_inverse=True)
        pair, self.times = np.unique(at * max(self.n, 1) + w.doc, return_counts=True)
        at, self.query = np.divmod(pair, max(self.n, 1))
        self.start = np.searchsorted(at, np.arange(len(self.terms) + 1))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the asked terms among ``terms``, and where they stand there."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        hit = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, dtype=np.int64)
        return at[hit], hit


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def _frequencies(shared) -> object:
    """(number of the term, documents that hold it) of the asked terms, summed over a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for b in batches:
            found = np.zeros(len(asked.terms), dtype=np.int64)
            (terms, t), (term_at, a), (entry_at, e) = _lists(b, "terms"), _lists(b, "term_at"), _lists(b, "entry_at")
            for i in range(b.num_rows):
                v, at = asked.find(terms[t[i]:t[i + 1]].view(np.uint64))
                ends = entry_at[e[i]:e[i + 1]][term_at[a[i]:a[i + 1]]]
                found[v] += ends[at + 1] - ends[at]
            v = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(found[v])], ["v", "df"])

    return run


class _Visited:
    """What a piece holds of the asked terms."""

    def __init__(self, asked: Asked, weights: np.ndarray, m: int, terms, term_at, tfs, entry_at, docs, size: int):
        v, at = asked.find(terms.view(np.uint64))
        first, last = term_at[at].astype(np.int64), term_at[at + 1].astype(np.int64)
        entries = ranges(first, last)
        self.docs, self.size = docs, size
        self.start, self.stop = entry_at[entries].astype(np.int64), entry_at[entries + 1].astype(np.int64)
        tf, which = np.unique(tfs[entries].astype(np.int64), return_inverse=True)
        self.impact = impact(tf, m)[which]
        self.hit_at = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
        times = ranges(asked.start[v], asked.start[v + 1])
        hit = np.repeat(np.arange(len(v)), asked.start[v + 1] - asked.start[v])
        query, gain = asked.query[times], weights[v][hit] * asked.times[times]
        most = self.impact[self.hit_at[1:] - 1][hit] if len(v) else np.zeros(0, dtype=np.int64)
        # Sums of doubles: a little more than the bound, never less.
        self.bound = np.bincount(query, gain * most.astype(np.float64), asked.n) * (1 + 1e-9)
        order = np.argsort(query, kind="stable")
        self.hit, self.gain = hit[order], gain[order]
        self.of = np.searchsorted(query[order], np.arange(asked.n + 1))

    def scores(self, q: int) -> np.ndarray:
        """The score of every document of the piece for the query."""
        hit, gain = self.hit[self.of[q]:self.of[q + 1]], self.gain[self.of[q]:self.of[q + 1]]
        a, b = self.hit_at[hit], self.hit_at[hit + 1]
        entries = ranges(a, b)
        value = np.repeat(gain, b - a) * self.impact[entries]
        start, stop = self.start[entries], self.stop[entries]
        out = np.zeros(self.size, dtype=np.int64)
        np.add.at(out, self.docs[ranges(start, stop)], np.repeat(value, stop - start))
        return out


def _visitor(shared, top: int, best_only: bool) -> object:
    """The best documents of every batch for every query: at most ``top``, none below the query's least score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, least = shared.value
        reached = np.zeros((asked.n, top), dtype=np.int64)
        for b in batches:
            ids, at = b.column("ids").flatten(), _lists(b, "docs")[1]
            offsets = b.column("ids").offsets.to_numpy()
            offsets = offsets - offsets[0]
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
            lists = [_lists(b, c) for c in _COLUMNS[2:]]
            m = b.column("m").to_numpy()
            pieces = [_Visited(asked, weights, int(m[i]), *(x[o[i]:o[i + 1]] for x, o in lists), int(offsets[i + 1] - offsets[i]))
                      for i in range(len(at) - 1)]
            bounds = np.array([p.bound for p in pieces]).reshape(len(pieces), asked.n)
            out_q, out_at, out_score = [], [], []
            for q in range(asked.n):
                order = np.argsort(-bounds[:, q], kind="stable")
                places, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                for i in order[:1] if best_only else order:
                    floor = max(int(least[q]), int(reached[q, 0]), 1)
                    if bounds[i, q] < floor:
                        break
                    own = pieces[i].scores(q)
                    own_at = np.flatnonzero(own >= floor)
                    if not len(own_at):
                        continue
                    places, scores = np.concatenate([places, own_at + offsets[i]]), np.concatenate([scores, own[own_at]])
                    keep = np.lexsort((rank[places], -scores))[:top]
                    places, scores = places[keep], scores[keep]
                    now = np.sort(np.concatenate([reached[q], own[own_at]]))[-top:]
                    reached[q] = now
                out_q.append(np.full(len(places), q))
                out_at.append(places)
                out_score.append(scores)
            if out_q:
                taken = ids.take(pa.array(np.concatenate(out_at), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q), pa.int32()), taken, pa.array(np.concatenate(out_score))], ["q", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each query; partitions send no more than that of each."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Distinct items with a term in blocks of bounded words, each collected when it is asked for."""
    asked = items.select("item_id", "text", F.regexp_count("text", F.lit(TERM)).alias("n")).filter("n > 0").distinct()
    asked = written(asked, "items")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 if total <= block_words else -(-2 * total // block_words)
    for p in range(parts if total else 0):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else asked
        block = [(r[0], r[1]) for r in part.select("item_id", "text").collect()]
        if block:
            yield block


def search(index: Index, items: DataFrame, top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per item (item_id, text) its ``top`` best documents: item_id, rank, doc_id, score."""
    spark = items.sparkSession
    context, kind = spark.sparkContext, index.pieces.schema["ids"].dataType.elementType.simpleString()
    item_kind = dict(items.dtypes)["item_id"]
    done = None
    for block in _blocks(items, block_words) if index.documents else ():
        asked = Asked([t for _, t in block])
        terms = context.broadcast(asked)
        held = index.pieces.select("terms", "term_at", "entry_at").mapInArrow(_frequencies(terms), "v int, df long")
        weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("df") + 1)))
        weights = np.zeros(len(asked.terms), dtype=np.int64)
        for v, w in held.groupBy("v").agg(F.sum("df").alias("df")).select("v", weight).collect():  # terms of one block
            weights[v] = w
        terms.destroy()
        found, least = None, np.zeros(asked.n, dtype=np.int64)
        for best_only in (True, False):
            shared = context.broadcast((asked, weights, least))
            visited = index.pieces.mapInArrow(_visitor(shared, top, best_only), f"q int, doc_id {kind}, score long")
            found = written(_ranked(visited, top), "found")
            shared.destroy()
            if best_only:
                for q, score in found.filter(F.col("rank") == top).select("q", "score").collect():  # queries of one block
                    least[q] = score
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {item_kind}")
        named = found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        done = named if done is None else done.unionByName(named)
    if done is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    return done

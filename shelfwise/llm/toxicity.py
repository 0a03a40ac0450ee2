"""Toxic spans by a linear-chain conditional random field.

Documents carry the labels, words do not: a word counts as toxic where, in the
learning sample, it or its beginning stands in clearly more different surroundings (word before,
word after) of toxic documents than of clean ones. Counting surroundings keeps
copies of one toxic document from marking all its words. With those words
labelled, a two-state chain (features: the word, its beginnings and
its end; transitions) is fitted in numpy by gradient steps on its likelihood. Forward-backward over
chains of CHAIN words gives the marginal of every word of the whole text.

A document's score is a logistic function, fitted on the same sample, of the sum
of its marginals from NOTABLE on, their share of the words, and the largest. Runs of words with a marginal of a half
or more come back as spans of code points.

Learning takes at most about SAMPLE documents and SAMPLE_BYTES of text of each label,
the whole text of each, drawn by hash from the rows the caller allows, and all chains with a word
labelled toxic. A text that does not fit into what is left of the bytes is passed over; a
text longer than SAMPLE_BYTES is scored, not learned from. A null or
empty text scores 0, as does every text when no toxic document can be learned
from. Null labels teach nothing; a document labelled twice counts by its
highest label. Repeated rows get a row each, and are one in the sample; a null ``doc_id`` is
kept. Other columns are carried, ``score`` and ``spans`` replaced. Equal texts score alike. Empty
tables give an empty result or scores of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.sources.storage import written

SAMPLE = 1500
SAMPLE_BYTES = 16 << 20  # of each label
CHAIN = 128
NOTABLE = 0.05
STEMS = (4, 6, 8)
N_FEATURES = len(STEMS) + 2
BITS = 18
MIN_SURROUNDINGS, MIN_ODDS = 6, 12.0
STEPS = 40


def units(w: words.Words, h: np.ndarray) -> list[np.ndarray]:
    """Hashes per word: the word, its beginnings of STEMS bytes (shorter words: the whole), its last three bytes."""
    length, out = w.end - w.start, [h]
    stem = np.zeros(len(h), dtype=np.uint64)
    for k in range(max(STEMS)):
        byte = np.where(length > k, w.data[np.minimum(w.start + k, max(len(w.data) - 1, 0))], 0).astype(np.uint64)
        stem = stem * np.uint64(257) + byte + np.uint64(1)
        if k + 1 in STEMS:
            out.append(words.mix(stem + np.uint64(k)))
    tail = np.zeros(len(h), dtype=np.uint64)
    for k in range(3):
        byte = np.where(length > k, w.data[np.maximum(w.end - 1 - k, 0)], 0).astype(np.uint64)
        tail = tail * np.uint64(257) + byte + np.uint64(1)
    return [*out, words.mix(tail + np.uint64(77))]


def features(w: words.Words, h: np.ndarray) -> np.ndarray:
    """Per word the places of its features in one weight vector."""
    return np.stack([(u >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS) for k, u in enumerate(units(w, h))])


def chains(first: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (CHAIN, rows) of chains that do not cross documents, and which are words."""
    count = np.diff(first)
    per = -(-count // CHAIN)
    doc = np.repeat(np.arange(len(count)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    at = (first[:-1][doc] + number * CHAIN)[None, :] + np.arange(CHAIN)[:, None]
    keep = at < first[1:][doc][None, :]
    return np.where(keep, at, 0), keep


class Crf:
    """Log-odds weights of state 1, transition scores (from, to) and the start's log-odds."""

    def __init__(self):
        self.w = np.zeros(N_FEATURES << BITS, dtype=np.float32)
        self.bias, self.start, self.t = -4.0, -4.0, np.zeros((2, 2))
        self.document = np.zeros(4)

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return sum((self.w[f] for f in feats[1:]), self.w[feats[0]] + np.float32(self.bias))

    def messages(self, e: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds for emissions (steps, rows); rows end where keep ends."""
        t, (steps, rows) = self.t, e.shape
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + self.start
        for i in range(1, steps):
            x = a[i - 1]
            a[i] = e[i] + np.logaddexp(x + t[1, 1], t[0, 1]) - np.logaddexp(x + t[1, 0], t[0, 0])
        for i in range(steps - 2, -1, -1):
            x = e[i + 1] + b[i + 1]
            b[i] = np.where(keep[i + 1], np.logaddexp(x + t[1, 1], t[1, 0]) - np.logaddexp(x + t[0, 1], t[0, 0]), 0)
        return a, b

    def marginals(self, e: np.ndarray, keep: np.ndarray) -> np.ndarray:
        a, b = self.messages(e, keep)
        return 0.5 * (1 + np.tanh(0.5 * (a + b)))

    def fit(self, feats: np.ndarray, label: np.ndarray, at: np.ndarray, keep: np.ndarray, steps: int = STEPS) -> None:
        """Adagrad on the likelihood of the labelled chains."""
        squares, small = np.zeros_like(self.w), np.zeros(6)
        y = label[at] & keep
        f = feats[:, at]
        n = keep.shape[1]
        for _ in range(steps):
            e = np.where(keep, self.emissions(f), 0.0)
            a, b = self.messages(e, keep)
            p = 0.5 * (1 + np.tanh(0.5 * (a + b)))
            gap = np.where(keep, y - p, 0.0)
            g = np.zeros_like(squares)
            for k in range(N_FEATURES):
                g += np.bincount(f[k].reshape(-1), gap.reshape(-1), len(g)).astype(np.float32)
            g -= 0.01 * self.w
            squares += g * g
            self.w += 0.5 * g / (np.sqrt(squares) + 1e-6)
            # Pair marginals, from the messages around each pair.
            live = keep[1:]
            gt = np.zeros((2, 2))
            score = np.stack([[self.t[i, j] + i * a[:-1] + j * (e[1:] + b[1:]) for j in (0, 1)] for i in (0, 1)])
            score = np.exp(score - score.max(axis=(0, 1)))
            score /= score.sum(axis=(0, 1))
            for i in (0, 1):
                for j in (0, 1):
                    gt[i, j] = (((y[:-1] == i) & (y[1:] == j) & live).sum() - (score[i, j] * live).sum())
            move = np.array([gap.sum(), gap[0].sum(), *gt.reshape(-1)]) / n
            small += move * move
            move = 0.3 * move / (np.sqrt(small) + 1e-6)
            self.bias, self.start = self.bias + move[0], self.start + move[1]
            self.t += move[2:].reshape(2, 2)


def toxic_units(unit: np.ndarray, around: np.ndarray, in_toxic: np.ndarray) -> np.ndarray:
    """Sorted units with clearly more different surroundings where ``in_toxic`` holds than elsewhere."""
    share = []
    for side in (in_toxic, ~in_toxic):
        order = np.lexsort((around[side], unit[side]))
        u, a = unit[side][order], around[side][order]
        new = np.ones(len(u), dtype=bool)
        new[1:] = (u[1:] != u[:-1]) | (a[1:] != a[:-1])
        share.append((*np.unique(u[new], return_counts=True), max(int(new.sum()), 1)))
    (t, nt, all_t), (c, nc, all_c) = share
    clean = np.zeros(len(t))
    if len(c):
        at = np.minimum(np.searchsorted(c, t), len(c) - 1)
        clean = np.where(c[at] == t, nc[at], 0)
    odds = (nt / all_t) / ((clean + 0.5) / all_c)
    return t[(nt >= MIN_SURROUNDINGS) & (odds >= MIN_ODDS)]


def toxic_words(w: words.Words, h: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of toxic texts (``toxic`` per text) are labelled toxic."""
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:], after[:-1] = h[:-1], h[1:]
    around = words.mix(before * np.uint64(3) + after * np.uint64(5))
    in_toxic = toxic[w.doc]
    found = np.zeros(len(h), dtype=bool)
    for unit in units(w, h)[:-1]:
        found |= np.isin(unit, toxic_units(unit, around, in_toxic))
    return found & in_toxic


def evidence(p: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text what its words' marginals come to: (1, log of their sum, log of their share, the largest)."""
    total, most = np.bincount(doc, p * (p >= NOTABLE), len(count)), np.zeros(len(count))
    np.maximum.at(most, doc, p)
    return np.stack([np.ones(len(count)), np.log(total + 0.01), np.log(total / np.maximum(count, 1) + 1e-5), most], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression by Newton's steps, with a small ridge."""
    b = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(len(b))
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ b)))
        grad = x.T @ (weight * (y - p)) - ridge @ b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, grad)
        b += step / max(1.0, np.abs(step).max() / 2)
    return b


def within(sizes: list, limit: int) -> list[tuple]:
    """The (doc_id, key) of rows (doc_id, key, toxic, size), in their order, that fit into ``limit`` bytes a label."""
    used, out = {True: 0, False: 0}, []
    for r in sizes:
        toxic = r["toxic"] == 1
        if used[toxic] + r["size"] <= limit:
            used[toxic] += r["size"]
            out.append((r["doc_id"], r["key"]))
    return out


def fit(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Crf | None:
    """A chain learned from labelled documents where ``learn`` (of doc_id) holds; None without toxic words."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(learn)
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    h = F.xxhash64("doc_id", F.lit(21))
    share = F.when(F.col("toxic") == 1, min(1.0, sample / max(counts.get(1, 0), 1))).otherwise(min(1.0, sample / max(counts.get(0, 0), 1)))
    drawn = marks.filter(F.pmod(h, F.lit(1 << 30)) < share * float(1 << 30)).orderBy(h, "doc_id").limit(4 * sample)
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("key")).filter(F.length("text") > 0)
    found = written(texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "key"]), "labelled")
    order, names = [F.xxhash64("doc_id"), F.col("key")], found.select("doc_id", "key").schema
    sizes = found.select("doc_id", "key", "toxic", F.octet_length("text").alias("size")).orderBy(*order).limit(4 * sample).collect()
    chosen = found.sparkSession.createDataFrame(within(sizes, sample_bytes), names)
    rows = found.join(F.broadcast(chosen), ["doc_id", "key"]).orderBy(*order).select("text", "toxic").collect()
    toxic = np.array([r["toxic"] == 1 for r in rows], dtype=bool)
    if not toxic.any():
        return None
    w = words.words_of(pa.array([r["text"] for r in rows], pa.string()), words.ALNUM)
    hashes = w.hashes()
    label = toxic_words(w, hashes, toxic)
    if not label.any():
        return None
    numbers, keep = chains(w.first, len(hashes))
    # All chains with a toxic word, and thrice as many without, evenly taken.
    has = (label[numbers] & keep).any(axis=0)
    others = np.flatnonzero(~has)
    take = np.concatenate([np.flatnonzero(has), others[::max(1, len(others) // (3 * int(has.sum()) + 200))]])
    model = Crf()
    model.fit(features(w, hashes), label, numbers[:, take], keep[:, take])
    # The sample's clean documents stand for all clean ones.
    stands_for = {k: max(1.0, counts.get(k, 0) / sample) for k in (0, 1)}
    weight = np.array([stands_for[int(t)] for t in toxic])
    model.document = logistic(evidence(word_marginals(model, w), w.doc, w.count), toxic.astype(float), weight / weight.mean())
    return model


def word_marginals(model: Crf, w: words.Words) -> np.ndarray:
    """The marginal of every word; chains are taken some thousand at a time."""
    numbers, keep = chains(w.first, len(w.start))
    e = model.emissions(features(w, w.hashes()))
    p = np.zeros(len(e))
    for i in range(0, keep.shape[1], 4096):
        n, k = numbers[:, i:i + 4096], keep[:, i:i + 4096]
        p[n[k]] = model.marginals(np.where(k, e[n], 0.0), k)[k]
    return p


def score_block(model: Crf, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score of each text and its toxic spans in code points."""
    w = words.words_of(column, words.ALNUM)
    n = len(column)
    score, spans = np.zeros(n), [[] for _ in range(n)]
    if not len(w.start):
        return score, spans
    p = word_marginals(model, w)
    score = np.where(w.count > 0, 0.5 * (1 + np.tanh(0.5 * (evidence(p, w.doc, w.count) @ model.document))), 0.0)
    raw, offsets = words.text_bytes(column)
    hit = np.flatnonzero(p >= 0.5)
    for run in np.split(hit, np.flatnonzero((np.diff(hit) > 1) | (np.diff(w.doc[hit]) > 0)) + 1) if len(hit) else []:
        d = w.doc[run[0]]
        points = lambda end, d=d: int(((raw[offsets[d]:end] & 0xC0) != 0x80).sum())
        spans[d].append((points(w.start[run[0]]), points(w.end[run[-1]])))
    return score, spans


def _scorer(model: Crf | None):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.blocks(batches):
            score, spans = (np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]) if model is None else score_block(model, b.column("text"))
            found = [[{"start": a, "end": z} for a, z in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.minimum(score, 1.0), pa.float64()), pa.array(found, span)], [*b.schema.names, "score", "spans"])

    return run


def score(documents: DataFrame, model: Crf | None) -> DataFrame:
    """``documents`` with ``score`` and ``spans`` (start, end in code points)."""
    rows = documents.drop("score", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(
        lambda batches: _scorer(shared.value)(batches), f"{schema}, score double, spans array<struct<start: long, end: long>>")

"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Tokens are lower-cased words and one end per text. The probability of a token
is P(class | context) * P(token | class). The most frequent tokens are classes of
their own, the others fall into classes by their last bytes. The class softmax
has features hashed into FEATURE_ROWS rows each: the word before, the two words
before, the word two back and the word three back alone (skips), the ending of
the word before, and a bias. P(token | class) = (c + 1) / (N_class + V_class + 1),
where one place is left for all tokens never seen.

Counts come from all training texts: every task adds up its own tokens, and
Spark sums them. Weights are trained in turns of distributed gradient updates:
each task starts from the broadcast weights, takes Adagrad steps over all of its
texts, and the tasks' weights are averaged by tokens, again in Spark. The first
turn takes a quarter of the texts (by hash) to warm up, the next ones all.

Scoring reads every text once. Counts of the most frequent HEAD tokens at most
are broadcast, as sorted numpy arrays; all other tokens are joined with their
counts by shuffle.

A null or empty text is an end alone. Without training texts all counts are 0.
Repeated rows get a row each and count as often; a null ``doc_id`` is kept. An
empty table gives an empty result. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.sources.storage import written

OWN_CLASSES = 16
ENDING_CLASSES = 16
CLASSES = OWN_CLASSES + ENDING_CLASSES
FEATURES = 5
FEATURE_ROWS = 4096
HEAD = 1 << 17
BATCH = 8192
TURNS = 2
RATE = 0.3
_SLICE = 64 * CLASSES
END = int(words.mix(np.array([0xE0D], dtype=np.uint64))[0])
_SALT = words.seeds(FEATURES, 0x1F)


class Tokens:
    """Tokens of a block: hash, ending, the row of each, and where rows begin."""

    def __init__(self, column: pa.Array):
        w = words.words_of(column, words.NOT_SPACE)
        n, rows = len(w.start), len(column)
        self.first = w.first + np.arange(rows + 1)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        at = np.arange(n) + w.doc
        self.hash = np.full(n + rows, END, dtype=np.uint64)
        self.hash[at] = w.hashes()
        self.ending = np.zeros(n + rows, dtype=np.uint64)
        last = w.data[w.end - 1].astype(np.uint64) if n else np.zeros(0, np.uint64)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64) if n else last
        self.ending[at] = words.mix(last * np.uint64(257) + before + np.uint64(1))

    def classes(self, own: np.ndarray) -> np.ndarray:
        """Class of each token; ``own`` are the sorted hashes with classes of their own."""
        out = OWN_CLASSES + (self.ending % np.uint64(ENDING_CLASSES)).astype(np.int64)
        at = np.minimum(np.searchsorted(own, self.hash), len(own) - 1)
        return np.where(own[at] == self.hash, at, out)

    def features(self) -> np.ndarray:
        """Rows (FEATURES, n) of the weight table for the context of each token."""
        n = len(self.hash)
        place = np.arange(n) - self.first[:-1][self.row]
        back = []
        for k in (1, 2, 3):
            h = np.zeros(n, dtype=np.uint64)
            h[k:] = self.hash[:-k] if k < n else h[k:]
            back.append(np.where(place >= k, h, np.uint64(k)))
        ending = np.zeros(n, dtype=np.uint64)
        ending[1:] = self.ending[:-1]
        ending = np.where(place >= 1, ending, np.uint64(9))
        parts = [back[0], back[0] * np.uint64(3) + back[1], back[1], back[2], ending]
        return np.stack([(words.mix(p ^ s) >> np.uint64(64 - 12)).astype(np.uint16) for p, s in zip(parts, _SALT)])


def start_weights() -> np.ndarray:
    """One table for all features, and the bias as its last row."""
    return np.zeros((FEATURES * FEATURE_ROWS + 1, CLASSES), dtype=np.float32)


def log_classes(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Natural log of the class probabilities for the features (FEATURES, n)."""
    z = np.take(weights, f[0].astype(np.int64), axis=0)
    for k in range(1, FEATURES):
        z += np.take(weights, f[k].astype(np.int64) + k * FEATURE_ROWS, axis=0)
    z += weights[-1]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


class Trainer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.squares, self.tokens = weights.copy(), np.full(weights.shape, 1e-3, dtype=np.float32), 0

    def step(self, f: np.ndarray, cls: np.ndarray) -> None:
        gap = -np.exp(log_classes(self.weights, f))
        gap[np.arange(len(cls)), cls] += 1
        self._move(np.array([len(self.weights) - 1]), gap.sum(axis=0, keepdims=True) / 64)
        for k in range(FEATURES):
            order = np.argsort(f[k], kind="stable")
            rows = f[k][order]
            begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            self._move(rows[begin].astype(np.int64) + k * FEATURE_ROWS, np.add.reduceat(gap[order], begin, axis=0))
        self.tokens += len(cls)

    def _move(self, rows: np.ndarray, g: np.ndarray) -> None:
        s = self.squares[rows] + g * g
        self.squares[rows] = s
        self.weights[rows] += RATE * g / np.sqrt(s)


def _merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, c, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h)
    h, c, n = h[order], c[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[begin], c[begin], np.add.reduceat(n, begin)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own sums of its tokens, given out whenever they have grown to a million."""
    parts: list[tuple] = []
    held = 0

    def out(merged):
        return pa.RecordBatch.from_arrays([pa.array(merged[0].view(np.int64)), pa.array(merged[1], pa.int32()), pa.array(merged[2], pa.int64())],
                                          ["token", "class", "c"])

    for b in words.blocks(batches):
        t = Tokens(b.column("text"))
        if len(t.hash):
            parts.append(_merge([(t.hash, OWN_CLASSES + (t.ending % np.uint64(ENDING_CLASSES)).astype(np.int32), np.ones(len(t.hash), dtype=np.int64))]))
            held += len(parts[-1][0])
        if held > 1_000_000:
            parts = [_merge(parts)]
            held = len(parts[0][0])
            if held > 700_000:
                yield out(parts[0])
                parts, held = [], 0
    if parts:
        yield out(_merge(parts))


def token_counts(texts: DataFrame) -> DataFrame:
    """Per token of ``texts``: token (hash), class by its ending, c."""
    return written(texts.select("text").mapInArrow(_count_batches, "token long, class int, c long")
                   .groupBy("token").agg(F.first("class").alias("class"), F.sum("c").alias("c")), "tokens")


def _trained(texts: DataFrame, weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One turn: the tasks' weights after their steps, averaged by tokens."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((weights, own))
    size = weights.size
    slices = -(-size // _SLICE)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own = shared.value
        trainer = Trainer(start)
        for b in words.blocks(batches):
            t = Tokens(b.column("text"))
            f, cls = t.features(), t.classes(own)
            for i in range(0, len(cls), BATCH):
                trainer.step(f[:, i:i + BATCH], cls[i:i + BATCH])
        if trainer.tokens:
            flat = np.zeros(slices * _SLICE)
            flat[:size] = (trainer.weights - start).reshape(-1) * float(trainer.tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()), pa.array(np.full(slices, trainer.tokens), pa.int64()),
                 words.list_array(flat.astype(np.float32), np.full(slices, _SLICE))], ["slice", "n", "moved"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            rows = b.column("moved").flatten().to_numpy().reshape(-1, _SLICE)
            for s, k, v in zip(b.column("slice").to_pylist(), b.column("n").to_pylist(), rows):
                total[s] = total.get(s, 0.0) + v.astype(np.float64)
                n[s] = n.get(s, 0) + k
        if total:
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), words.list_array(np.concatenate([total[k] / n[k] for k in keys]).astype(np.float32), np.full(len(keys), _SLICE))],
                ["slice", "moved"])

    moved = texts.select("text").mapInArrow(steps, "slice int, n long, moved array<float>")
    mean = moved.repartition("slice").mapInArrow(summed, "slice int, moved array<float>").collect()  # the size of one model
    flat = np.zeros(slices * _SLICE, dtype=np.float32)
    for r in mean:
        flat[r["slice"] * _SLICE:(r["slice"] + 1) * _SLICE] = r["moved"]
    return weights + flat[:size].reshape(weights.shape)


class Model:
    """Weights, classes' sizes, totals, and the head of the counts."""

    def __init__(self, weights, own, class_log, n, v, head, head_counts, least):
        self.weights, self.own, self.class_log = weights, own, class_log
        self.n, self.v, self.head, self.head_log, self.least = n, v, head, np.log10(head_counts + 1.0), least

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, head tokens, their sum of log10(c + 1), the context's part of the score; and the other tokens."""
        t = Tokens(column)
        rows = len(column)
        f, cls = t.features(), t.classes(self.own)
        part = -self.class_log[cls]
        for i in range(0, len(cls), BATCH):
            p = log_classes(self.weights, f[:, i:i + BATCH])
            part[i:i + BATCH] += p[np.arange(len(p)), cls[i:i + BATCH]] / np.log(10)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, t.hash), len(self.head) - 1)
            known = self.head[at] == t.hash
            value = np.where(known, self.head_log[at], 0.0)
        else:
            known, value = np.zeros(len(t.hash), dtype=bool), np.zeros(len(t.hash))
        total = lambda x: np.bincount(t.row, x, rows)
        return np.diff(t.first), total(known).astype(np.int64), total(value), total(part), t.hash[~known], t.row[~known]


def fit(texts: DataFrame, turns: int = TURNS, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model learned from ``texts`` (text), and the counts of all of their tokens."""
    counts = token_counts(texts)
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = END - (1 << 64) if END >= 1 << 63 else END
    top = counts.filter(F.col("token") != end).orderBy(F.desc("c"), "token").limit(OWN_CLASSES - 1).select("token").collect()
    own = np.sort(np.array([END, *[r["token"] % (1 << 64) for r in top]], dtype=np.uint64))
    signed = [int(x) for x in own.view(np.int64)]
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(signed) for x in (k, i)]), F.col("token")), F.col("class"))
    sizes = counts.groupBy(number.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_log = np.zeros(CLASSES)
    for r in sizes:
        class_log[r["k"]] = np.log10(r["n"] + r["v"] + 1.0)
    # The least power of two from which no more than ``head`` tokens count as often.
    levels = {r["k"]: r["v"] for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("v")).collect()}
    level, fits = 64, 0
    while level > 0 and fits + levels.get(level - 1, 0) <= head:
        level, fits = level - 1, fits + levels.get(level - 1, 0)
    least = 1 << level
    often = counts.filter(F.col("c") >= least).select("token", "c").toArrow()
    h = often.column("token").to_numpy().view(np.uint64)
    order = np.argsort(h)
    weights = start_weights()
    warm = texts.filter(F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    for turn in range(turns):
        weights = _trained(warm if turn < turns - 1 else texts, weights, own)
    return Model(weights, own, class_log, totals[0], totals[1], h[order], often.column("c").to_numpy()[order], least), counts


def scored(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``documents`` without text, with n_tokens, n_known, train_tokens, base_score and score."""
    docs = documents.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.blocks(batches):
            n, known, value, part, other, row = shared.value.score(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in rest], pa.array(n, pa.int64()), pa.array(known), pa.array(value), pa.array(part),
                 words.list_array(other.view(np.int64), np.bincount(row, minlength=b.num_rows))],
                [*[f.name for f in rest], "n_tokens", "_known", "_value", "_part", "_other"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    first = docs.mapInArrow(run, schema + "n_tokens long, _known long, _value double, _part double, _other array<long>")
    first = written(first.withColumn("_row", F.monotonically_increasing_id()), "scores")
    rare = counts.filter(F.col("c") < model.least)
    found = first.select("_row", F.explode("_other").alias("token")).join(rare, "token").groupBy("_row").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.log10(F.col("c") + 1.0)).alias("_s"))
    both = first.drop("_other").join(found, "_row", "left")
    value = F.col("_value") + F.coalesce("_s", F.lit(0.0))
    return both.select(
        *[f.name for f in rest], "n_tokens", (F.col("_known") + F.coalesce("_n", F.lit(0))).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (value - F.col("n_tokens") * float(np.log10(model.n + model.v + 1.0))).alias("base_score"),
        (value + F.col("_part")).alias("score"))


def score_documents(documents: DataFrame, learn: Column) -> DataFrame:
    """Scores of all ``documents`` by a model learned from those where ``learn`` holds."""
    model, counts = fit(documents.filter(learn).select("text"))
    return scored(documents, model, counts)

"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read segments of SEGMENT bytes, one forwards and one
backwards. A softmax over both states labels every byte, and a document's
probabilities are the means over all its bytes; the whole text is read. The
network is trained in numpy, by backpropagation through time with Adam, on
windows of a bounded sample: at most about SAMPLE windows for each language,
drawn by hash from the rows the caller allows, at least one of every language.
The sample is read PASSES times, in STEPS steps at the least, and a text is in
none of the languages if its best label has less probability than that of all
whole texts the sample was drawn from (less SLACK, for rounding).
With ``whole`` the network then goes on learning from all bytes of all rows the
caller allows: at each of SLICES steps the tasks add up the gradients over the
rows of one slice, dealt by hash, and the driver moves the parameters by the
mean. All languages count alike, whatever their bytes, as in the sample.
Prediction sees the text only.

A text that is null or has no letter is ``und`` with score 0, and so is every
text when there is nothing to learn from. Rows without a language teach
nothing. Repeated rows get a row each; a null ``doc_id`` is kept. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words

SEGMENT = 128
HIDDEN = 8
SAMPLE = 500
STEPS = 150
BATCH = 200
PASSES = 15
RATE = 0.02
SLICES = 4
LEARN_ROWS = 512
PIECES = 8
SLACK = 0.01
UNKNOWN = "und"
_f = np.float32


class _Adam:
    """Moving means of gradients and their squares."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}
        self.steps = 0

    def move(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        for k in p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.s[k] = 0.99 * self.s[k] + 0.01 * g[k] ** 2
            move = self.m[k] / (1 - 0.9 ** self.steps) / (np.sqrt(self.s[k] / (1 - 0.99 ** self.steps)) + 1e-7)
            p[k] -= (rate * move).astype(_f)


class Network:
    """Parameters: input tables (2, 256, 3H), recurrent (2, H, 3H), output (2, H, L), bias (L)."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        self.languages = languages
        self.least = 0.0  # the best label's probability below which a text is in none of the languages
        self.p = {
            "x": (rng.standard_normal((2, 256, 3 * h)) * 0.3).astype(_f),
            "u": (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(_f),
            "o": (rng.standard_normal((2, h, n)) * 0.3).astype(_f),
            "b": np.zeros(n, dtype=_f),
        }

    def states(self, data: np.ndarray, keep: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (2, steps, rows, H) of the byte matrix (steps, rows); a byte not kept leaves the state as it is."""
        h, (steps, rows) = HIDDEN, data.shape
        out = np.empty((2, steps, rows, h), dtype=_f)
        state = np.zeros((2, rows, h), dtype=_f)
        x = np.empty((2, rows, 3 * h), dtype=_f)
        whole = bool(keep.all())
        for t in range(steps):
            for d, at in ((0, t), (1, steps - 1 - t)):
                np.take(self.p["x"][d], data[at], axis=0, out=x[d], mode="clip")
            rec = np.matmul(state, self.p["u"])
            gates = x[:, :, :2 * h] + rec[:, :, :2 * h]
            gates *= _f(0.5)
            np.tanh(gates, out=gates)
            gates *= _f(0.5)
            gates += _f(0.5)
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = r * rec[:, :, 2 * h:]
            new += x[:, :, 2 * h:]
            np.tanh(new, out=new)
            after = state - new
            after *= z
            after += new
            if not whole:
                live = np.stack([keep[t], keep[steps - 1 - t]])[:, :, None]
                after = np.where(live, after, state)
            if tape is not None:
                tape.append((state, z, r, new, rec[:, :, 2 * h:]))
            state = after
            out[0, t], out[1, steps - 1 - t] = state[0], state[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = np.matmul(states[0], self.p["o"][0])
        logits += np.matmul(states[1], self.p["o"][1])
        logits += self.p["b"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, keep: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all kept bytes, by backpropagation through time."""
        h, (steps, rows) = HIDDEN, data.shape
        tape: list = []
        states = self.states(data, keep, tape)
        err = self.probabilities(states)
        err[:, np.arange(rows), label] -= 1
        err *= (keep / max(keep.sum(), 1)).astype(_f)[:, :, None]
        flat = err.reshape(-1, err.shape[-1])
        g = {
            "o": np.stack([states[d].reshape(-1, h).T @ flat for d in (0, 1)]),
            "b": flat.sum(axis=0),
            "u": np.zeros_like(self.p["u"]), "x": np.zeros_like(self.p["x"]),
        }
        from_out = np.stack([err @ self.p["o"][d].T for d in (0, 1)])
        inputs = np.empty((2, steps, rows, 3 * h), dtype=_f)
        back = np.zeros((2, rows, h), dtype=_f)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, rec_n = tape[t]
            at = (t, steps - 1 - t)
            back = back + np.stack([from_out[0, at[0]], from_out[1, at[1]]])
            live = np.stack([keep[at[0]], keep[at[1]]])[:, :, None]
            d_after = np.where(live, back, 0)
            d_new = d_after * (1 - z) * (1 - new * new)
            d_z = d_after * (before - new) * z * (1 - z)
            d_r = d_new * rec_n * r * (1 - r)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=2)
            for d in (0, 1):
                inputs[d, at[d]] = np.concatenate([d_z[d], d_r[d], d_new[d]], axis=1)
            g["u"] += np.matmul(before.transpose(0, 2, 1), d_rec)
            back = np.where(live, d_after * z, back) + np.matmul(d_rec, self.p["u"].transpose(0, 2, 1))
        seen = data.reshape(-1)
        for d in (0, 1):
            own = inputs[d].reshape(-1, 3 * h)
            for k in range(3 * h):
                g["x"][d, :, k] = np.bincount(seen, own[:, k], 256)
        return g

    def _forward(self, data: np.ndarray, keep: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (steps + 1, 2, H, rows), direction 1 in its own order; rows lie last in memory, so that numpy's loops are long."""
        h, (steps, rows) = HIDDEN, data.shape
        whole = bool(keep.all())
        table = [np.ascontiguousarray(self.p["x"][d].T) for d in (0, 1)]
        into = np.ascontiguousarray(self.p["u"].transpose(0, 2, 1))
        states = np.zeros((steps + 1, 2, h, rows), dtype=_f)
        gates, news, recs = (np.empty((steps if tape is not None else 1, 2, k * h, rows), dtype=_f) for k in (2, 1, 1))
        if tape is not None:
            tape += [gates, news, recs]
        x = np.empty((2, 3 * h, rows), dtype=_f)
        rec = np.empty_like(x)
        for t in range(steps):
            for d, at in ((0, t), (1, steps - 1 - t)):
                np.take(table[d], data[at], axis=1, out=x[d], mode="clip")
            state, after, own = states[t], states[t + 1], t % len(gates)
            gate, new = gates[own], news[own]
            np.matmul(into, state, out=rec)
            np.add(x[:, :2 * h], rec[:, :2 * h], out=gate)
            gate *= _f(0.5)
            np.tanh(gate, out=gate)
            gate *= _f(0.5)
            gate += _f(0.5)
            recs[own] = rec[:, 2 * h:]
            np.multiply(gate[:, h:], recs[own], out=new)
            new += x[:, 2 * h:]
            np.tanh(new, out=new)
            np.subtract(state, new, out=after)
            after *= gate[:, :h]
            after += new
            if not whole:
                np.copyto(after, state, where=~np.stack([keep[t], keep[steps - 1 - t]])[:, None, :])
        return states

    def _labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (steps, L, rows) of the states of ``_forward``."""
        out = np.matmul(self.p["o"][0].T, states[1:, 0])
        out += np.matmul(self.p["o"][1].T, states[:0:-1, 1])
        out += self.p["b"][:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def label_sums(self, data: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Probabilities (rows, L) summed over the kept bytes of each row."""
        p = self._labels(self._forward(data, keep))
        p *= keep[:, None, :]
        return p.sum(axis=0).T

    def gradient_sums(self, data: np.ndarray, keep: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """As ``gradients``, but sums, a row's bytes counting ``weight``."""
        h, (steps, rows), p = HIDDEN, data.shape, self.p
        whole = bool(keep.all())
        tape: list[np.ndarray] = []
        states = self._forward(data, keep, tape)
        gates, news, recs = tape
        live = lambda t: np.stack([keep[t], keep[steps - 1 - t]])[:, None, :]
        out = (states[1:, 0], states[:0:-1, 1])  # by place in the text
        err = self._labels(states)
        err[:, label, np.arange(rows)] -= 1
        err *= (keep * weight).astype(_f)[:, None, :]
        g = {
            "o": np.stack([np.matmul(out[d], err.transpose(0, 2, 1)).sum(axis=0) for d in (0, 1)]),
            "b": err.sum(axis=(0, 2)), "u": np.zeros_like(p["u"]), "x": np.empty_like(p["x"]),
        }
        from_out = [np.matmul(p["o"][d], err) for d in (0, 1)]
        back = np.zeros((2, h, rows), dtype=_f)
        d_rec = np.empty((2, 3 * h, rows), dtype=_f)
        d_z, d_r = d_rec[:, :h], d_rec[:, h:2 * h]
        d_new, by_z = np.empty_like(back), np.empty_like(back)
        for t in range(steps - 1, -1, -1):
            before, z, r, new = states[t], gates[t][:, :h], gates[t][:, h:], news[t]
            for d, at in ((0, t), (1, steps - 1 - t)):
                back[d] += from_out[d][at]
            if not whole:
                passed, back = np.where(live(t), 0, back), np.where(live(t), back, 0)
            np.multiply(new, new, out=d_new)
            np.subtract(1, d_new, out=d_new)
            np.subtract(1, z, out=by_z)
            d_new *= by_z
            d_new *= back
            by_z *= z
            by_z *= back
            np.subtract(before, new, out=d_z)
            d_z *= by_z
            np.subtract(1, r, out=d_r)
            d_r *= r
            d_r *= recs[t]
            d_r *= d_new
            np.multiply(d_new, r, out=d_rec[:, 2 * h:])
            g["u"] += np.matmul(before, d_rec.transpose(0, 2, 1))
            back *= z
            back += np.matmul(p["u"], d_rec)
            if not whole:
                back += passed
            gates[t], news[t] = d_rec[:, :2 * h], d_new  # in the place of what is no longer needed
        for d, seen in ((0, data), (1, data[::-1])):
            seen = seen.reshape(-1).astype(np.intp)
            for k in range(3 * h):
                own = gates[:, d, k] if k < 2 * h else news[:, d, k - 2 * h]
                g["x"][d, :, k] = np.bincount(seen, own.reshape(-1), 256)
        return g

    def train(self, data: np.ndarray, keep: np.ndarray, label: np.ndarray, steps: int | None = None, rate: float = RATE) -> _Adam:
        steps = max(STEPS, -(-PASSES * len(label) // BATCH)) if steps is None else steps
        rng = np.random.default_rng(2)
        adam = _Adam(self.p)
        order = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(BATCH, len(label)):
                order = np.concatenate([order, rng.permutation(len(label))])
            pick, order = order[:BATCH], order[BATCH:]
            adam.move(self.p, self.gradients(data[:, pick], keep[:, pick], label[pick]), rate * (1 - 0.9 * step / steps))
        return adam


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (SEGMENT, n) of all segments of all texts, which of them are text, and each segment's text."""
    size = np.diff(offsets)
    per = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][doc] + number * SEGMENT
    at = start[None, :] + np.arange(SEGMENT)[:, None]
    keep = at < offsets[1:][doc][None, :]
    return data[np.where(keep, at, 0)] if len(data) else np.zeros(at.shape, np.uint8), keep, doc


def pooled(network: Network, column: pa.Array) -> np.ndarray:
    """Mean label probabilities of all bytes of each text."""
    data, offsets = words.text_bytes(column)
    total = np.zeros((len(column), len(network.languages)))
    bytes_, keep, doc = segments(data, offsets)
    rows = 2048
    for i in range(0, len(doc), rows):
        part = slice(i, i + rows)
        p = network.probabilities(network.states(np.ascontiguousarray(bytes_[:, part]), keep[:, part]))
        p *= keep[:, part, None]
        np.add.at(total, doc[part], p.sum(axis=0))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _pooled_whole(network: Network, column: pa.Array) -> np.ndarray:
    """As ``pooled`` but for rounding, in three quarters of the time."""
    data, offsets = words.text_bytes(column)
    total = np.zeros((len(column), len(network.languages)))
    bytes_, keep, doc = segments(data, offsets)
    order = np.argsort(~keep.all(axis=0), kind="stable")  # full segments need no masks
    for i in range(0, len(doc), LEARN_ROWS):
        own = order[i:i + LEARN_ROWS]
        np.add.at(total, doc[own], network.label_sums(np.ascontiguousarray(bytes_[:, own]), np.ascontiguousarray(keep[:, own])))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _sampled(labelled: DataFrame, per_language: int) -> tuple[list, DataFrame | None, dict[str, tuple[int, int]]]:
    """Hash-drawn windows (text, lang), about ``per_language`` of each language, the rows they come from, and all languages' rows and bytes."""
    h = F.xxhash64("doc_id", "text", F.lit(11))
    rank = F.pmod(h, F.lit(1 << 30))
    counts = labelled.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("least"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not counts:
        return [], None, {}
    spark = labelled.sparkSession
    shares = spark.createDataFrame(
        [(r["lang"], max(per_language / r["n"] * (1 << 30), r["least"] + 1.0)) for r in counts], "lang string, below double")
    at = F.pmod(F.xxhash64("text", F.lit(12)), F.greatest(F.length("text") - SEGMENT, F.lit(0)) + 1).cast("int")
    drawn = labelled.join(F.broadcast(shares), "lang").filter(rank < F.col("below"))
    window = F.expr(f"substring(text, _at + 1, {SEGMENT})")
    picked = drawn.withColumn("_at", at).select(window.alias("text"), "lang", h.alias("h"))
    rows = picked.distinct().orderBy("h", "text", "lang").collect()  # a repeated row teaches once
    return rows, drawn, {r["lang"]: (r["n"], r["bytes"]) for r in counts}


def _summed_gradients(network: Network, labelled: DataFrame, shares: dict[str, float]) -> tuple[dict[str, np.ndarray], float]:
    """Gradients over all bytes of all rows, a byte of a language counting its share, and the sum of these shares."""
    sizes = {k: v.size for k, v in network.p.items()}
    weight = np.array([shares[x] for x in network.languages])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(sum(sizes.values()) + 1), []

        def count(most: int) -> None:
            """Full segments together, others together, up to ``most`` rows left over of each."""
            parts = [np.concatenate(c, axis=-1) for c in zip(*held)] if held else []
            held.clear()
            if not parts:
                return
            full = parts[1].all(axis=0)
            for own in (np.flatnonzero(full), np.flatnonzero(~full)):
                for i in range(0, len(own), LEARN_ROWS):
                    data, keep, label = (np.ascontiguousarray(c[..., own[i:i + LEARN_ROWS]]) for c in parts)
                    if len(label) <= most and len(label) < LEARN_ROWS:
                        held.append((data, keep, label))
                        continue
                    g = network.gradient_sums(data, keep, label, weight[label])
                    total[:-1] += np.concatenate([g[k].reshape(-1) for k in sizes])
                    total[-1] += (keep.sum(axis=0) * weight[label]).sum()

        for b in words.blocks(batches):
            label = np.array([network.languages.index(x) for x in b.column("lang").to_pylist()], dtype=np.int64)
            data, keep, doc = segments(*words.text_bytes(b.column("text")))
            held.append((data, keep, label[doc]))
            count(LEARN_ROWS)
        count(0)
        if total[-1]:
            parts = np.array_split(total, PIECES)
            task = np.full(PIECES, TaskContext.get().partitionId(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(task), pa.array(parts, pa.list_(pa.float64()))], ["piece", "task", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r["piece"], r["task"], r["part"]) for b in batches for r in b.to_pylist())  # in one order, so that reruns agree
        for piece in dict.fromkeys(p for p, _, _ in found):
            part = np.sum([v for p, _, v in found if p == piece], axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([part], pa.list_(pa.float64()))], ["piece", "part"])

    each = labelled.select("text", "lang").mapInArrow(counted, "piece int, task int, part array<double>")
    pieces = each.repartition(PIECES, "piece").mapInArrow(summed, "piece int, part array<double>").collect()  # the size of one network
    if not pieces:
        return {}, 0.0
    total = np.concatenate([r["part"] for r in sorted(pieces, key=lambda r: r["piece"])])
    ends = np.cumsum(list(sizes.values()))[:-1]
    return {k: v.reshape(network.p[k].shape) for k, v in zip(sizes, np.split(total[:-1], ends))}, float(total[-1])


def _learn_whole(network: Network, adam: _Adam, labelled: DataFrame, counts: dict[str, tuple[int, int]]) -> None:
    """Every row teaches once more, with all its bytes, at the rate the training of the sample ended with."""
    shares = {lang: 1 / bytes_ for lang, (_, bytes_) in counts.items()}
    slices = max(1, min(SLICES, sum(n for n, _ in counts.values()) // BATCH))
    of = F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(slices))
    for k in range(slices):
        g, total = _summed_gradients(network, labelled.filter(of == k), shares)
        if total:
            adam.move(network.p, {name: (v / total).astype(_f) for name, v in g.items()}, 0.1 * RATE)


def fit(
    documents: DataFrame, learn: Column, per_language: int = SAMPLE, judge: bool = True, whole: bool = True
) -> Network | None:
    """A network learned from the rows where ``learn`` holds; None if there are none.

    Without ``judge`` its ``least`` stays 0, which spares a pass where nothing is to be dropped; without ``whole``
    it learns from the sample only.
    """
    labelled = documents.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    rows, drawn, counts = _sampled(labelled, per_language)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    network = Network(languages)
    data, offsets = words.text_bytes(pa.array([r["text"] for r in rows], pa.string()))
    bytes_, keep, doc = segments(data, offsets)
    label = np.array([languages.index(r["lang"]) for r in rows])[doc]
    adam = network.train(bytes_, keep, label)
    if whole:
        _learn_whole(network, adam, labelled, counts)
    if judge:
        # Never below chance, as a part of it would be when there are few languages.
        least = predict(drawn.select("text"), network, _pooled_whole).filter(F.col("lang_pred") != UNKNOWN).agg(F.min("score")).first()[0]
        network.least = (1 - SLACK) * (least or 0.0)
    return network


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _predictor(network: Network | None, pool=pooled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.blocks(batches):
            lettered = [_has_letter(t) for t in b.column("text").to_pylist()]
            lang, score = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            if network is not None:
                p = pool(network, b.column("text"))
                for i, (k, x) in enumerate(zip(p.argmax(axis=1), p.max(axis=1))):
                    if lettered[i]:
                        lang[i], score[i] = network.languages[k], min(float(x), 1.0)
            rest = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return run


def predict(documents: DataFrame, network: Network | None, pool=pooled) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``."""
    rows = documents.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_predictor(network, pool), f"{schema}, lang_pred string, score double")


def accepted(documents: DataFrame, network: Network | None) -> DataFrame:
    """``documents`` in a language: texts without a letter go, and those whose best label has less than ``network.least``.

    Without a network all texts with a letter stay.
    """
    network = Network(["any"]) if network is None else network
    kept = documents.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"})
    found = predict(kept, network, _pooled_whole).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= network.least))
    own = found.drop("lang_pred", "score").withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"})
    return own.select(*documents.columns)

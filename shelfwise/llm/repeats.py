"""Repeated passages of LENGTH bytes or more, found by suffix order and removed.

Where they are. Every window of LENGTH bytes names an anchor: the smallest of
the hashes of its KGRAM-byte strings, the first of equals. Equal windows name
equal anchors at the same place in them, so a window can only start elsewhere
if its anchor does. An anchor's surroundings are the bytes of all windows that
can name it; hashes of anchors and surroundings of all texts are counted in Spark.
Anchors that occur once are done. Surroundings that occur twice are repeats
throughout. What is left are surroundings that share the anchor only:
mostly the ends of repeats.

Where they end. The surroundings that share an anchor are put together, their
suffixes are sorted with the common prefixes of neighbours. The longest previous
factor of a position is the longer common prefix with the previous and the next
smaller position in suffix order, the longest next factor likewise with greater
positions. A window is a later copy where its previous factor has LENGTH bytes, and
any copy where one of both has; only that is asked, so no array of factors is kept:
suffixes with LENGTH bytes in common are a run, and all of a run but its smallest
position have such a previous factor. Groups are bounded: where more than GROUP different surroundings share
an anchor, ranges of windows are counted by hash in Spark first. The bytes that
all windows of a range have in common must occur twice, or the range is done; where
all bytes of the range occur twice, all its windows do, and one stands for all. Those that share
the common bytes only are again a group, of the bytes of the range, and are sorted as above; only
where there are more than GROUP of them is the range split into narrower ones, down to single windows.

Removal takes every byte of a repeated window, on the input. With ``keep_first``
the first copy stays, in the order of text hash and position.

Texts are UTF-8 bytes; null is empty and nothing is repeated in it. Texts shorter
than LENGTH have no windows; very long ones are read in one task, a stretch at a time. Equal texts are one text with a count. Repeated
rows get a row each; a null ``doc_id`` is kept. What is kept need not be UTF-8,
since a removal may end inside a character. Other columns are left out. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.sources.bucketed import stored_bytes
from shelfwise.sources.storage import written

LENGTH = 400
KGRAM = 64
LEFT = LENGTH - KGRAM  # a window that names an anchor starts at most so far before it
GROUP = 4096  # a few MB of surroundings in one sort
# Widths of the ranges of windows into which larger groups are split, one turn after the other.
WIDTHS = (169, 43, 11, 3, 1)
BROADCAST_BYTES = 32 << 20  # of stored files
_PLACE_BITS = 28


class Prefixes:
    """Polynomial hashes of any stretch of a block of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = words.powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(words.BYTE[data] * up[:len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.total[end] - self.total[start]
        return words.mix(h * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each of the len(x) - w + 1 stretches of w values."""
    n = len(x)
    full = np.full(-(-n // w) * w, ~np.uint64(0))
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def smallest_places(grams: np.ndarray) -> np.ndarray:
    """For each window the place of the smallest hash in it, the first of equals (by all but the last _PLACE_BITS bits)."""
    bits, step, out = np.uint64(_PLACE_BITS), 1 << (_PLACE_BITS - 1), []
    for begin in range(0, len(grams) - LEFT, step):  # a stretch at a time, since a place has _PLACE_BITS bits
        part = grams[begin:begin + step + LEFT]
        keys = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(keys, LEFT + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) + begin)
    return np.concatenate(out)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of each text: its row, place in the block, hash, and hash of its surroundings."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    p = Prefixes(data)
    at = np.arange(len(data) - KGRAM + 1)
    grams = p.of(at, at + KGRAM)
    named = smallest_places(grams)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[:len(named)]
    whole = np.arange(len(named)) + LENGTH <= offsets[1:][row]
    place, row = named[whole], row[whole]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    place, row = place[new], row[new]
    start, end = surroundings(place, row, offsets)
    around = words.mix(p.of(start, end) + (place - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, place, grams[place], around


def surroundings(place: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(place - LEFT, offsets[:-1][row]), np.minimum(place + LENGTH, offsets[1:][row])


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words.blocks(batches):
        data, offsets = words.text_bytes(b.column("text"))
        row, place, h, around = anchors(data, offsets)
        keep = np.bincount(row, minlength=b.num_rows)
        some = pa.array(keep > 0)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("text_id"), pa.array(np.diff(offsets), pa.int64()),
            words.list_array(place - offsets[:-1][row], keep), words.list_array(h.view(np.int64), keep),
            words.list_array(around.view(np.int64), keep)], ["doc_id", "text_id", "n", "at", "anchor", "around"]).filter(some)


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted ranges of windows of each text."""
    for b in words.blocks(batches):
        data, offsets = words.text_bytes(b.column("text"))
        wanted = b.column("wanted").to_pylist()
        row = np.repeat(np.arange(b.num_rows), [len(w) for w in wanted])
        items = [x for w in wanted for x in w]
        place = np.array([x["at"] for x in items], dtype=np.int64) + offsets[:-1][row]
        low, high = (np.array([x[c] for x in items], dtype=np.int64) for c in ("low", "high"))
        start, end = np.maximum(place - high, offsets[:-1][row]), np.minimum(place - low + LENGTH, offsets[1:][row])
        yield pa.RecordBatch.from_arrays([
            pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array([x["core"] for x in items], pa.int64()),
            pa.array([x["anchor"] for x in items], pa.int64()), pa.array([x["around"] for x in items], pa.int64()),
            pa.array(b.column("text_id").to_numpy()[row] if len(row) else [], pa.int64()), pa.array(place - offsets[:-1][row], pa.int64()),
            pa.array(place - start, pa.int32()), pa.array([data[s:e].tobytes() for s, e in zip(start, end)], pa.binary()),
        ], [*_RANGE, "anchor", "around", "text_id", "at", "before", "piece"])


_RANGE = ["low", "high", "core"]  # a group: the first and last window by bytes before the anchor, and a hash of what all of them share


class Pieces:
    """Surroundings, or the part of a range of windows, side by side, aligned at their anchors: bytes (columns, n), and the columns each fills."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        n, width = len(rows), LEFT + LENGTH
        self.bytes = np.zeros((n, width), dtype=np.uint8)
        self.low, self.high = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        for i, (before, piece) in enumerate(rows):
            self.low[i], self.high[i] = LEFT - before, LEFT - before + len(piece)
            self.bytes[i, self.low[i]:self.high[i]] = np.frombuffer(piece, dtype=np.uint8)
        self.bytes = np.ascontiguousarray(self.bytes.T)

    def whole(self, column: int) -> np.ndarray:
        """Which pieces have all of the window that starts at the column."""
        return (self.low <= column) & (column + LENGTH <= self.high)


def repeated_windows(pieces: Pieces, order_of: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which windows (n, LEFT + 1; by bytes before the anchor) have a copy, or an earlier one.

    Suffixes that start in the same column are sorted, for all columns from the last to the first, by
    putting the column's byte before the order of the column after it. With the order goes the first column
    in which neighbours differ: this one, or the least of those between them in the order before. Two suffixes
    have a common prefix up to the least of those between them, so suffixes that agree in LENGTH bytes are a run.
    A smaller position in a run is the previous or next smaller one, or beyond it in the run, so the previous
    factor falls short only for the smallest of each run; with greater positions likewise.
    """
    width, n = pieces.bytes.shape
    found = np.zeros((n, LEFT + 1), dtype=bool)
    order, differ = np.arange(n), np.full(n, width)
    for column in range(width - 1, -1, -1):
        byte = pieces.bytes[column][order]
        by = np.argsort(byte, kind="stable")
        order, byte = order[by], byte[by]
        differ = np.minimum.reduceat(differ, by)
        differ[:-1][byte[1:] != byte[:-1]] = column
        if column > LEFT:
            continue
        at = np.flatnonzero(pieces.whole(column)[order])
        if len(at) < 2:
            continue
        seq = order[at]
        same = np.minimum.reduceat(differ, at)[:-1] >= column + LENGTH
        if not same.any():
            continue
        if keep_first:
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            smallest = np.minimum.reduceat(order_of[seq], begin)
            hit = order_of[seq] > np.repeat(smallest, np.diff(np.append(begin, len(seq))))
        else:
            hit = np.zeros(len(seq), dtype=bool)
            hit[1:] = same
            hit[:-1] |= same
        found[seq[hit], LEFT - column] = True
    return found


def _matched(keep_first: bool):
    def flush(rows: list[dict]) -> pa.RecordBatch:
        pieces = Pieces([(r["before"], r["piece"]) for r in rows])
        places = np.array([(r["text_id"], r["at"]) for r in rows], dtype=np.int64)
        rank = np.empty(len(rows), dtype=np.int64)
        rank[np.lexsort((places[:, 1], places[:, 0]))] = np.arange(len(rows))
        found = repeated_windows(pieces, rank, keep_first)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[k]["anchor"] for k in i], pa.int64()), pa.array([rows[k]["around"] for k in i], pa.int64()),
            pa.array(low, pa.int32()), pa.array(high - 1, pa.int32())], ["anchor", "around", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group; whole groups are taken together until they are enough for one sort.

        The ranges of one text have no window in common, so a window never meets itself.
        """
        rows: list[dict] = []
        last, seen = None, set()
        for b in batches:
            for r in b.to_pylist():
                if (group := [r[c] for c in _RANGE]) != last:
                    if len(rows) >= GROUP:
                        yield flush(rows)
                        rows = []
                    last, seen = group, set()
                if (own := (r["anchor"], r["around"])) not in seen:  # a repeated row yields its pieces again
                    seen.add(own)
                    rows.append(r)
        if rows:
            yield flush(rows)

    return run


def _node_batches(width: int):
    """Ranges of windows, cut to ``width``, by the hash of the bytes all of them share and of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.blocks(batches):
            data, offsets = words.text_bytes(b.column("text"))
            rows = [(i, x["anchor"], x["around"], x["at"], low, min(low + width - 1, n["high"]))
                    for i, w in enumerate(b.column("wanted").to_pylist()) for x in w for n in x["nodes"]
                    for low in range(n["low"], n["high"] + 1, width)]
            if not rows:
                continue
            row, anchor, around, at, low, high = (np.array(c, dtype=np.int64) for c in zip(*rows))
            begin, stop = offsets[:-1][row], offsets[1:][row]
            p, place = Prefixes(data), offsets[:-1][row] + at
            core = (place - low >= begin) & (place - high + LENGTH <= stop)
            whole = (place - high >= begin) & (place - low + LENGTH <= stop)
            row, anchor, around, at, low, high, place, whole = (c[core] for c in (row, anchor, around, at, low, high, place, whole))
            shared = p.of(place - low, place - high + LENGTH)
            first, last = np.where(whole, place - high, place), np.where(whole, place - low + LENGTH, place)
            extent = np.where(whole, p.of(first, last), words.mix(around.view(np.uint64) + np.uint64(5)))
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor), pa.array(around), pa.array(b.column("text_id").to_numpy()[row], pa.int64()), pa.array(at),
                pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(shared.view(np.int64)),
                pa.array(extent.view(np.int64)), pa.array(whole)],
                ["anchor", "around", "text_id", "at", "low", "high", "core", "extent", "whole"])

    return run


def _split_ranges(documents: DataFrame, contexts: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """``contexts`` range by range; no group meets in one task.

    Returns repeated windows (anchor, around, low, high), and groups of GROUP ranges at the most that have
    their common bytes only in common (anchor, around, rep, low, high, core).
    """
    place = contexts.select("anchor", "around", "rep")
    active = place.select("anchor", "around", F.lit(0).alias("low"), F.lit(LEFT).alias("high"))
    found, unsure = [], []
    for width in WIDTHS:
        nodes = active.groupBy("anchor", "around").agg(F.collect_list(F.struct("low", "high")).alias("nodes")).join(place, ["anchor", "around"])
        wanted = written(nodes.groupBy(F.col("rep.text_id").alias("text_id"), F.col("rep.doc_id").alias("doc_id")).agg(
            F.collect_list(F.struct("anchor", "around", F.col("rep.at").alias("at"), "nodes")).alias("wanted")), "wanted")
        rows = written(_of_texts(documents, wanted).mapInArrow(
            _node_batches(width), "anchor long, around long, text_id long, at long, low int, high int, core long, extent long, whole boolean"
        ), "ranges")
        # A repeated row yields its surroundings again; they are one.
        kinds = rows.groupBy(*_RANGE, "extent").agg(
            F.min(F.struct("text_id", "at", "around", "anchor")).alias("one"), F.max("around").alias("z"), F.min("around").alias("a"))
        kinds = written(kinds, "kinds")
        same = rows.filter("whole").join(kinds.filter("a != z"), [*_RANGE, "extent"])
        if keep_first:
            same = same.filter((F.col("around") != F.col("one.around")) | (F.col("anchor") != F.col("one.anchor")))
        found.append(written(same.select("anchor", "around", "low", "high"), "ranges"))
        # Without keep_first nothing is left to find where each kind occurs twice.
        several = kinds.groupBy(*_RANGE).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.lit(keep_first) | (F.col("a") == F.col("z"))).alias("close"))
        several = kinds.join(several.filter("n > 1 and close"), _RANGE).select("one.anchor", "one.around", *_RANGE, "n")
        several = written(several, "several")
        unsure.append(several.filter(F.col("n") <= GROUP).join(place, ["anchor", "around"]).select("anchor", "around", "rep", *_RANGE))
        active = several.filter(F.col("n") > GROUP).drop("core", "n")
        if active.isEmpty():
            break
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, unsure)


def _broadcast(table: DataFrame) -> DataFrame:
    """A written table with a hint if its files, whose rows hold lists, are small; else the planner decides."""
    return F.broadcast(table) if stored_bytes(table) <= BROADCAST_BYTES else table


def _of_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``documents`` joined with one row per wanted text (text_id, doc_id; a written table)."""
    wanted = _broadcast(wanted)
    d, w = documents.alias("d"), wanted.alias("w")
    same = (F.col("d.text_id") == F.col("w.text_id")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    return d.join(w, same).select("d.text_id", "d.text", "w.wanted")


def _pieces(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    wanted = written(ranges.groupBy(F.col("rep.text_id").alias("text_id"), F.col("rep.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("anchor", "around", F.col("rep.at").alias("at"), *_RANGE)).alias("wanted")), "wanted")
    return _of_texts(documents, wanted).mapInArrow(
        _piece_batches, "low int, high int, core long, anchor long, around long, text_id long, at long, before int, piece binary")


def repeated_spans(documents: DataFrame, keep_first: bool = False) -> DataFrame:
    """Per text of ``documents`` (doc_id, text_id, text) with repeats: text_id, spans (start, end; maximal runs of bytes)."""
    kind = dict(documents.dtypes)["doc_id"]
    named = written(documents.mapInArrow(
        _anchor_batches, f"doc_id {kind}, text_id long, n long, at array<long>, anchor array<long>, around array<long>"), "anchors")
    every = named.select("doc_id", "text_id", "n", F.explode(F.arrays_zip("at", "anchor", "around")).alias("x")).select(
        "doc_id", "text_id", "n", "x.at", "x.anchor", "x.around")
    twice = written(named.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor"), "twice")
    shared = written(every.join(twice, "anchor"), "shared")
    contexts = written(shared.groupBy("anchor", "around").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("text_id", F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("rep")), "contexts")
    # Groups in which some surroundings need a closer look.
    close = F.min("k") == 1 if not keep_first else F.lit(True)
    groups = written(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), close.alias("close")).filter("kinds > 1 and close"), "groups")
    unsure = contexts.join(groups, "anchor")
    small = unsure.filter(F.col("kinds") <= GROUP).select(
        "anchor", "around", "rep", F.lit(0).alias("low"), F.lit(LEFT).alias("high"), F.col("anchor").alias("core"))
    large, found = unsure.filter(F.col("kinds") > GROUP), []
    if not large.isEmpty():
        full, few = _split_ranges(documents, written(large, "large"), keep_first)
        small, found = small.unionByName(few), [full]
    parts = _pieces(documents, small).repartition(*_RANGE).sortWithinPartitions(*_RANGE).mapInArrow(
        _matched(keep_first), "anchor long, around long, low int, high int")
    ranges = written(reduce(DataFrame.unionByName, found, parts).distinct(), "ranges")
    start, end = F.greatest(F.col("at") - LEFT, F.lit(0)), F.least(F.col("at") + LENGTH, F.col("n"))
    copies = shared.join(contexts.filter("k > 1").select("anchor", "around", "rep"), ["anchor", "around"])
    if keep_first:
        copies = copies.filter((F.col("text_id") != F.col("rep.text_id")) | (F.col("at") != F.col("rep.at")) | ~F.col("doc_id").eqNullSafe(F.col("rep.doc_id")))
    whole = copies.select("text_id", "doc_id", start.alias("start"), end.alias("end"))
    # Ranges matter for the first place of their surroundings only; all others are copies throughout.
    first = contexts if keep_first else contexts.filter("k = 1")
    part = ranges.join(first, ["anchor", "around"]).select(
        "rep.text_id", "rep.doc_id", (F.col("rep.at") - F.col("high")).alias("start"), (F.col("rep.at") - F.col("low") + LENGTH).alias("end"))
    spans = whole.unionByName(part)
    keys = ["text_id", "doc_id"] if keep_first else ["text_id"]
    by_text = spans.groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return written(by_text.mapInArrow(_merge_batches, by_text.schema), "spans")


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans as maximal runs, which are far fewer."""
    for b in batches:
        at = b.schema.get_field_index("spans")
        runs = [[{"start": x, "end": y} for x, y in merged(s)] for s in b.column(at).to_pylist()]
        yield b.set_column(at, b.schema.field(at), pa.array(runs, b.schema.field(at).type))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in words.blocks(batches):
        data, offsets = words.text_bytes(b.column("text"))
        whole, runs = data.tobytes(), [merged(s) for s in b.column("spans").to_pylist()]
        sizes, removed, hashes = np.diff(offsets), [], []
        for i, own in enumerate(runs):
            text, at, kept = whole[offsets[i]:offsets[i + 1]], 0, []
            for x, y in own:
                kept.append(text[at:x])
                at = y
            kept.append(text[at:])
            rest = b"".join(kept)
            removed.append(len(text) - len(rest))
            hashes.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
            pa.array(hashes, pa.string()), pa.array([[{"start": x, "end": y} for x, y in r] for r in runs], span)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def without_repeats(documents: DataFrame, keep_first: bool = False) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, removed (start, end in bytes)."""
    docs = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    spans = _broadcast(repeated_spans(docs, keep_first))
    d, s = docs.alias("d"), spans.alias("s")
    same = F.col("d.text_id") == F.col("s.text_id")
    if keep_first:
        same &= F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    kind = dict(docs.dtypes)["doc_id"]
    return d.join(s, same, "left").select("d.doc_id", "d.text", "s.spans").mapInArrow(
        _remove_batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "removed array<struct<start: long, end: long>>")

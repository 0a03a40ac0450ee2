"""License phrases by diagonal voting.

The rolling k-gram hashes of all words of all texts are joined with the
positions of the same k-grams in the templates. A match at text position p and
template position q votes for the diagonal p - q; votes are a bit set of
template positions, so that equal texts vote once. Diagonals that differ by at
most SLACK words are one span, whose words are then compared with the template
word by word. A phrase template stands only where all its words do; a statement
template may have words changed, left out or put in.

Templates are the module's constants, so their broadcast is bounded. Votes are
kept by the hash of the text: a group of copies is one text.

Null and empty texts have no words and no labels, with score 0. Repeated rows
get a row each; a null ``doc_id`` is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.sources.storage import written

# Phrases that count at every place, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Statements of common licenses, with their labels.
STATEMENTS = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution license": "cc-by",
    "dedicated to the public domain under cc0": "cc0",
}
K = 2
SLACK = 2
MIN_SIMILARITY = 0.75
# Texts with spans that are broadcast at most; more are joined by shuffle.
BROADCAST_TEXTS = 200_000

TEMPLATES = [(p.split(), label, True) for p, label in PHRASES.items()] + [
    (p.split(), label, False) for p, label in STATEMENTS.items()]


def _template_grams() -> list[tuple[int, int, int]]:
    """(gram, template, position) of all templates."""
    out = []
    for t, (ws, _, _) in enumerate(TEMPLATES):
        w = words.words_of(pa.array([" ".join(ws)]), words.ALNUM)
        grams = words.ngrams(w.hashes(), K).view(np.int64)
        out += [(int(g), t, q) for q, g in enumerate(grams)]
    return out


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words.blocks(batches):
        w = words.words_of(b.column("text"), words.ALNUM)
        grams = words.ngrams(w.hashes(), K).view(np.int64)
        counts = np.maximum(w.count - K + 1, 0)
        if len(grams):
            at = np.arange(len(grams))
            inside = at < (w.first[1:] - K + 1)[w.doc[:len(grams)]]
            grams = grams[inside]
        yield pa.RecordBatch.from_arrays([b.column("text_id"), words.list_array(grams, counts)], ["text_id", "grams"])


def diagonal_spans(texts: DataFrame) -> DataFrame:
    """Spans of (text_id, text) where a template may stand: text_id, template, first, after (words)."""
    spark = texts.sparkSession
    templates = spark.createDataFrame(_template_grams(), "gram long, template int, q int")
    grams = texts.mapInArrow(_gram_batches, "text_id long, grams array<long>").select("text_id", F.posexplode("grams").alias("p", "gram"))
    votes = grams.join(F.broadcast(templates), "gram").groupBy(
        "text_id", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, q))").alias("votes"))
    size = F.element_at(F.array(*[F.lit(len(t[0])) for t in TEMPLATES]), F.col("template") + 1)
    exact = F.element_at(F.array(*[F.lit(t[2]) for t in TEMPLATES]), F.col("template") + 1)
    rows = votes.withColumns({"size": size, "exact": exact})
    # All k-grams of a phrase vote for its place; places are never merged.
    places = rows.filter(F.col("exact") & (F.bit_count("votes") == F.col("size") - K + 1)).select(
        "text_id", "template", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size")).alias("after"))
    by = Window.partitionBy("text_id", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= SLACK, 0).otherwise(1)
    merged = rows.filter(~F.col("exact")).withColumn("new", apart).withColumn("span", F.sum("new").over(by)).groupBy(
        "text_id", "template", "span").agg(
        F.expr("bit_or(votes)").alias("votes"), F.min("diagonal").alias("first"), F.max(F.col("diagonal") + F.col("size")).alias("after"), F.first("size").alias("size"))
    # A statement that may be similar enough keeps at least a third of its k-grams.
    likely = merged.filter(3 * F.bit_count("votes") >= F.col("size") - K + 1)
    return places.unionByName(likely.select("text_id", "template", "first", "after"))


def _in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


_TEMPLATE_WORDS = [[w.encode() for w in ws] for ws, _, _ in TEMPLATES]


def _verify(w: words.Words, row: int, spans: list[dict]) -> list[tuple[int, int, int, float]]:
    """(template, first, after, similarity) of the spans that stand in the row's text."""
    begin, count = int(w.first[row]), int(w.count[row])
    out = []
    for s in spans:
        ws, (_, _, exact) = _TEMPLATE_WORDS[s["template"]], TEMPLATES[s["template"]]
        first, after = max(s["first"], 0), min(s["after"], count)
        have = [w.text(begin + i) for i in range(first, after)]
        if exact:
            similarity = 1.0 if have == ws else 0.0
        else:
            similarity = _in_order(ws, have) / len(ws)
        if similarity >= MIN_SIMILARITY:
            out.append((s["template"], first, after, similarity))
    # Of statements over the same words the one that fits best stands.
    chosen: list[tuple[int, int, int, float]] = []
    for t, first, after, x in sorted(out, key=lambda o: (-o[3], -len(_TEMPLATE_WORDS[o[0]]), o[0], o[1])):
        if TEMPLATES[t][2] or not any(first < z and a < after for u, a, z, _ in chosen if not TEMPLATES[u][2]):
            chosen.append((t, first, after, x))
    return chosen


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("similarity", pa.float64()), ("phrase", pa.bool_())])
    for b in words.blocks(batches):
        w = words.words_of(b.column("text"), words.ALNUM)
        found = []
        for i, spans in enumerate(b.column("spans").to_pylist()):
            hits = _verify(w, i, spans) if spans else []
            found.append([dict(label=TEMPLATES[t][1], first=a, after=z, similarity=x, phrase=TEMPLATES[t][2]) for t, a, z, x in sorted(hits)])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(found, pa.list_(span))], ["doc_id", "n_words", "found"])


def license_spans(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_words, found (label, first, after, similarity, phrase)."""
    docs = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    spans = diagonal_spans(docs.select("text_id", "text"))
    by_text = written(spans.groupBy("text_id").agg(F.collect_set(F.struct("template", "first", "after")).alias("spans")), "spans")
    if by_text.count() <= BROADCAST_TEXTS:
        by_text = F.broadcast(by_text)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.join(by_text, "text_id", "left").select("doc_id", "text", "spans").mapInArrow(
        _label_batches, f"doc_id {kind}, n_words long, found array<struct<label: string, first: long, after: long, similarity: double, phrase: boolean>>")

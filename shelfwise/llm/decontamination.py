"""Benchmark passages in documents, by one Aho-Corasick automaton over words.

Items and texts are normalised alike: A-Z lower-cased, words are runs of
letters, digits and non-ASCII characters. The automaton holds every window of
WINDOW consecutive words of an item (or the whole of a shorter item) as a
sequence of word numbers, and each text is scanned once. The automaton reports
at which word a window ends, and words know their place in the original text,
so hits come back as code-point offsets of it.

The benchmark is read by the driver in blocks of about BLOCK_WORDS words, one
after the other: a block is collected, broadcast, scanned for, what it found is
written, and the broadcast is released before the next one. So a larger
benchmark takes more scans and no more memory. With one block nothing is written.

Null texts and texts without words have no hits; null or wordless items match
nothing. An item without id marks words but is not listed. Items listed twice
count once. Documents keep a row each, repeated rows too; a null ``doc_id`` is
kept. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.storage import written

WINDOW = 10
BLOCK_WORDS = 200_000

_TO_SPACE = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
_built: dict[int, tuple] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_SPACE).split()


def build(items: list[tuple[str | None, str]], window: int = WINDOW) -> tuple[dict, object]:
    """Word numbers and the automaton; a window's value is its length and the items that have it."""
    numbers: dict[bytes, int] = {}
    owners: dict[tuple, set] = {}
    for item, text in items:
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text))
        for i in range(max(len(ids) - window, 0) + 1 if ids else 0):
            owners.setdefault(ids[i:i + window], set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, who in owners.items():
        automaton.add_word(key, (len(key), frozenset(who)))
    if owners:
        automaton.make_automaton()
    return numbers, automaton if owners else None


def scan(text: str | None, numbers: dict, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit runs as (first word, word after the last), and items found."""
    words = normal_words(text)
    if automaton is None or not words:
        return len(words), [], set()
    get = numbers.get
    runs: list[list[int]] = []
    found: set = set()
    for end, (length, who) in automaton.iter(tuple([get(w, 0) for w in words])):
        start = end - length + 1
        found |= who
        while runs and start <= runs[-1][1]:
            start = min(start, runs.pop()[0])
        runs.append([start, end + 1])
    return len(words), [(a, b) for a, b in runs], found


def offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """The code-point span of each run of words in the original text."""
    data = text.encode("utf-8", "replace")
    places, at = [], 0
    clean = data.translate(_TO_SPACE)
    for w in clean.split():
        at = clean.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    points = lambda a, b: len(data[a:b].decode("utf-8"))
    out, done, count = [], 0, 0
    for a, b in runs:
        start, stop = places[a][0], places[b - 1][1]
        count += points(done, start)
        begin, done = count, stop
        count += points(start, stop)
        out.append({"start": begin, "end": count})
    return out


def _scanner(block) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block.id if hasattr(block, "id") else id(block)
        if key not in _built:  # kept for the next task of this worker
            _built.clear()
            _built[key] = build(block.value)
        numbers, automaton = _built[key]
        for batch in batches:
            n, words, hits, items, spans = batch.num_rows, [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                count, runs, found = scan(text, numbers, automaton)
                words.append(count)
                hits.append([{"first": a, "after": b} for a, b in runs])
                items.append(sorted(str(x) for x in found if x is not None))
                spans.append(offsets(text, runs) if runs else [])
            pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
            cols = [pa.array(words, pa.int64()), pa.array(hits, pair("first", "after")),
                    pa.array(items, pa.list_(pa.string())), pa.array(spans, pair("start", "end"))]
            if n:
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "n_words", "hits", "items", "spans"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the spans of hits that are already known."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        spans = [offsets(t.as_py(), [(r["first"], r["after"]) for r in h]) if h else [] for t, h in zip(b.column("text"), b.column("hits").to_pylist())]
        yield b.append_column("spans", pa.array(spans, span))


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and the benchmark's distinct items in blocks of bounded words, each collected when it is asked for."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    items = benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null").distinct().withColumn("n", size)
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 if total <= block_words else -(-2 * total // block_words)
    if parts > 1:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        items = written(items.withColumn("part", part).repartitionByRange("part").sortWithinPartitions("part"), "benchmark")
    of = lambda p: items if parts == 1 else items.filter(F.col("part") == p)
    return parts, ([(r[0], r[1]) for r in of(p).select("item_id", "text").collect()] for p in range(parts))


def contaminated_words(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``documents``: its columns, n_words, hits (runs of words), items and spans (code points).

    ``hits`` and ``spans`` are lists, ``items`` the sorted ids of items with a window in the text.
    """
    spark = documents.sparkSession
    kept = documents.drop("n_words", "hits", "items", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + (
        ", n_words long, hits array<struct<first: long, after: long>>, items array<string>, spans array<struct<start: long, end: long>>")
    parts, blocks = _blocks(benchmark, block_words)
    if parts == 1:
        return kept.mapInArrow(_scanner(spark.sparkContext.broadcast(next(blocks))), schema)
    # Rows are told apart by a number, fixed by writing them, while the findings of all blocks are put together.
    numbered = written(kept.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    of_row = schema.replace(", n_words", ", __row long, n_words", 1)
    rows, found = None, None
    for b in blocks:
        shared = spark.sparkContext.broadcast(b)
        part = numbered.mapInArrow(_scanner(shared), of_row)
        # The first scan counts the words of all rows, the others tell of hits only.
        part = part.select("__row", "n_words", "hits", "items") if rows is None else part.filter(F.size("hits") > 0).select("__row", "hits", "items")
        part = written(part, "found")
        shared.destroy()
        rows, part = (part.select("__row", "n_words"), part.drop("n_words")) if rows is None else (rows, part)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("__row").agg(
        _merged("hits", "first", "after"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    together = numbered.join(rows, "__row").join(merged, "__row")
    return together.drop("__row").select(*kept.columns, "n_words", "hits", "items").mapInArrow(_placed, schema)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` in which no benchmark item has a window."""
    own = [c for c in ("n_words", "hits", "items", "spans") if c in documents.columns]
    kept = documents.withColumnsRenamed({c: f"__{c}" for c in own})
    found = contaminated_words(kept, benchmark).filter(F.size("hits") == 0).select(*kept.columns)
    return found.withColumnsRenamed({f"__{c}": c for c in own})


def _merged(name: str, a: str, b: str):
    """Runs of all blocks, overlapping or touching ones as one."""
    return F.expr(f"""aggregate(
        array_sort(flatten(collect_list({name}))), cast(array() as array<struct<{a}: bigint, {b}: bigint>>),
        (done, r) -> if(size(done) > 0 and element_at(done, -1).{b} >= r.{a},
            concat(slice(done, 1, size(done) - 1), array(named_struct(
                '{a}', element_at(done, -1).{a}, '{b}', greatest(element_at(done, -1).{b}, r.{b})))),
            concat(done, array(r))))""").alias(name)

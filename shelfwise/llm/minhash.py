"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch. Every coordinate of a sketch of T must hold a value. In round i < T
each shingle falls into the bin its i-th hash names, with the value
(i, hash); in round T + j every shingle falls into bin j. A bin keeps its
smallest value, so values of earlier rounds win, and a set is done after the
first round in which no bin is empty. Few rounds do for long texts, and 2 T at
the most for any. Two sets agree in a coordinate with probability equal to
their Jaccard similarity.

Candidates. BANDS bands of ROWS coordinates are bucket keys; a pair at the
threshold 0.75 shares no bucket with probability (1 - 0.75^4)^40 < 3e-7.

Verification. Documents with equal shingle sets are one class. Within a bucket
all pairs are not formed: a hub is drawn, every member of another component is
compared with it on full shingle sets, components are merged, the hub leaves
the bucket, and another is drawn. What shares a bucket of several components
after BAND_TURNS such turns is mostly texts with a passage in common that are not
similar. Their buckets are dealt anew by the rarest shingles of each set: with
shingles in any one order, two sets at the threshold share one of the first
n - ceil(0.75 n) + 1 of each, and the rarest are seldom those of a passage. Hubs
are drawn from these until each bucket is one component or has no pair left that was
not compared. A pair whose shingles after the shared one are too few to reach the
threshold need not be. So a pair that shares a bucket ends in one component
or was found not linked, and groups of thousands of near copies cost a few
comparisons per member.

Any column may be null; null and empty texts have no shingles and are linked
with nothing. A null ``doc_id`` never names a component unless all ids of it
are null. Repeated rows are copies of each other, each with a row of its own.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import words
from shelfwise.llm.columns import aside, back
from shelfwise.sources.storage import dropped, written

BANDS, ROWS = 40, 4
T = BANDS * ROWS
SHINGLE_WORDS = 5
SIMILARITY = 75  # per cent
# Ids of this many classes are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000
MEMBERS_PER_CHUNK = 64
# Turns with one hub of each band's bucket; then buckets are rare shingles, with so many hubs each turn, at last the last number.
BAND_TURNS = 2
HUBS = (256, 1024)
_MAX = np.uint64((1 << 64) - 1)
_SEEDS = words.seeds(2 * T, 0x51)
_BAND_SEEDS = words.seeds(T, 0xBA).reshape(BANDS, ROWS) | np.uint64(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches, one row of T values per set; empty sets stay at the maximum."""
    out = np.full((len(sets), T), _MAX, dtype=np.uint64)
    cells = out.reshape(-1)
    values, row = words.flat(sets)
    at = row * T
    for i in range(2 * T):
        if not len(values):
            break
        h = words.mix(values ^ _SEEDS[i])
        bins = (h % np.uint64(T)).astype(np.int64) if i < T else i - T
        np.minimum.at(cells, at + bins, (h >> np.uint64(9)) | np.uint64(i << 55))
        open_rows = (out == _MAX).any(axis=1)
        if not open_rows.all():
            still = open_rows[row]
            values, row, at = values[still], row[still], at[still]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    return words.mix((parts * _BAND_SEEDS).sum(axis=2, dtype=np.uint64))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words.blocks(batches):
        sets = words.shingle_sets(b.column("text"), SHINGLE_WORDS)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        keys = band_keys(sketch(sets))
        # The class of a set: a sum of mixed hashes, the same in any order.
        ids = np.array([words.mix(s ^ np.uint64(0xC1A55)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("text_id"), pa.array(sizes), pa.array(ids.view(np.int64)),
            words.list_array(keys.view(np.int64).reshape(-1), np.full(len(sets), BANDS)),
        ], ["doc_id", "text_id", "n_shingles", "class", "bands"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, chunk, role): the hub first, then members to compare with it."""
    hub, hub_set = None, None
    for b in words.blocks(batches):
        sets = words.shingle_sets(b.column("text"), SHINGLE_WORDS)
        found: list[tuple[int, int]] = []
        for h, member, own in zip(b.column("hub").to_pylist(), b.column("class").to_pylist(), sets):
            if member == h:
                hub, hub_set = h, own
            elif h == hub:
                both = len(np.intersect1d(hub_set, own, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(hub_set) + len(own) - both):
                    found.append((h, member))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, class) whose full shingle sets are similar enough, as edges (u, v)."""
    pairs = written(pairs, "pairs")
    chunks = written(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_CHUNK).cast("int").alias("chunks")), "hubs")
    members = pairs.join(chunks, "hub").withColumn("chunk", F.pmod(F.xxhash64("class"), "chunks"))
    asked = members.select("hub", "chunk", "class").unionByName(
        chunks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"),
                      F.col("hub").alias("class")))
    rows = asked.join(texts, "class")
    ordered = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("class") != F.col("hub"))
    links = written(ordered.select("hub", "class", "text").mapInArrow(_verify_batches, "u long, v long"), "links")
    dropped(pairs, chunks)
    return links


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v) by alternating large and small stars: (node, root)."""
    edges = written(edges.filter("u != v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "stars")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        before, edges = edges, written(small, "stars")
        dropped(before, large)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (class, central, comp) after joining the components that the edges (u, v) between classes connect."""
    of = lambda end: labels.select(F.col("class").alias(end), F.col("comp").alias(f"comp_{end}"))
    between = edges.join(of("u"), "u").join(of("v"), "v").select(F.col("comp_u").alias("u"), F.col("comp_v").alias("v"))
    roots = components(between)
    now = written(labels.join(roots, labels["comp"] == roots["node"], "left").select("class", "central", F.coalesce("root", "comp").alias("comp")), "labels")
    dropped(roots, labels, edges)
    return now


def _few(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_IDS else table


def _may_reach(n: Column, rest: Column, hub_n: Column, hub_rest: Column) -> Column:
    """Whether sets of n shingles, of which at most ``rest`` can be common, can be similar enough."""
    return (100 + SIMILARITY) * F.least(rest, hub_rest) >= SIMILARITY * (n + hub_n)


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words.blocks(batches):
        values, row = words.flat(words.shingle_sets(b.column("text"), SHINGLE_WORDS))
        sizes = np.bincount(row, minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column("class"), pa.array(sizes, pa.int64()), words.list_array(values.view(np.int64), sizes)], ["class", "n", "shingles"])


def _rare_buckets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The classes of ``members`` by the rarest shingles of each: (key, class, n, rest), rest from the key on.

    Shingles of one class alone are the rarest of all and no key of anything.
    """
    asked = members.select("class").distinct()
    sets = written(texts.join(asked, "class").mapInArrow(_shingle_batches, "class long, n long, shingles array<long>"), "sets")
    one = sets.select("class", "n", F.explode("shingles").alias("key"))
    counts = one.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    ranked = one.join(counts, "key").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("s"))
    first = F.col("n") - F.ceil(SIMILARITY * F.col("n") / 100) + 1 - (F.col("n") - F.size("s"))
    chosen = ranked.filter(first > 0).select("class", "n", F.size("s").alias("shared"), F.posexplode(F.slice("s", F.lit(1), first.cast("int"))).alias("at", "x"))
    rare = written(chosen.select(F.col("x.key").alias("key"), "class", "n", (F.col("shared") - F.col("at")).cast("long").alias("rest")), "rare")
    dropped(sets)
    return rare


def _drawn(members: DataFrame, per_bucket: int, turn: int) -> DataFrame:
    """At most ``per_bucket`` hubs of every bucket: the most central of each of as many hash groups.

    A text that shares its buckets with many others is likely to be linked with many of them. Groups are
    of components and of classes in turn: where most members are of one component, one hub of each other
    one is all it takes, and where there are several large ones, hubs of the same have to be drawn at once.
    """
    by = "comp" if turn % 2 else "class"
    group = F.pmod(F.xxhash64(by, F.lit(turn)), F.lit(per_bucket))
    return members.groupBy("key", group.alias("g")).agg(
        F.min(F.struct((-F.col("central")).alias("p"), "class", "n", "rest", "comp")).alias("h")).select("key", "h.*")


def class_links(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Components of the classes that share a bucket with another: (class, comp)."""
    spread = classes.select("class", "n", F.posexplode("bands").alias("band", "h")).select(
        F.xxhash64("band", "h").alias("key"), "class", "n")
    shared = spread.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count(F.lit(1)).alias("size")).filter("a != b").select("key", "size")
    buckets = written(spread.join(shared, "key"), "buckets")
    members, held = buckets.select("key", "class", "n", F.col("n").alias("rest")), [buckets]
    labels = written(buckets.groupBy("class").agg(F.sum("size").alias("central")).withColumn("comp", F.col("class")), "labels")
    wanted = labels.join(classes, "class").select("class", "rep.doc_id", "rep.text_id")
    wanted = _few(wanted, labels.count())
    d, w = documents.alias("d"), wanted.alias("w")
    texts = written(
        d.join(w, F.col("d.text_id").eqNullSafe(F.col("w.text_id")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
        .select("w.class", "d.text").dropDuplicates(["class"]), "texts")
    turn = 0
    while True:
        now = members.join(labels, "class")
        split = written(now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("key"), "split")
        open_buckets = split.count()
        if not open_buckets:
            dropped(split, texts, *held)
            return labels
        if turn == BAND_TURNS:
            turn, members = turn + 1, _rare_buckets(members.join(_few(split, open_buckets), "key"), texts)
            dropped(split, *held)
            held = [members]
            continue
        now = written(now.join(_few(split, open_buckets), "key"), "open")
        dropped(split, *held)
        per_bucket = 1 if turn < BAND_TURNS else HUBS[min(turn - BAND_TURNS - 1, len(HUBS) - 1)]
        # The hubs of a bucket as one row, so that every member meets them at once and is known as one of them.
        drawn = _drawn(now, per_bucket, turn).groupBy("key").agg(F.collect_list(F.struct("p", "class", "n", "rest", "comp")).alias("hubs"))
        hubs = written(drawn, "hubs")
        held = [now, hubs]
        met = now.join(_few(hubs, open_buckets * per_bucket), "key")
        apart = F.filter("hubs", lambda h: (h["comp"] != F.col("comp")) & _may_reach(F.col("n"), F.col("rest"), h["n"], h["rest"]))
        if turn == 0:  # one hub each; the bulk of every group is joined before more are tried
            nearest = F.array_min(F.transform(apart, lambda h: F.struct(h["p"].alias("p"), h["class"].alias("hub"))))
            pairs = met.select("class", nearest.alias("h")).filter("h IS NOT NULL").groupBy("class").agg(F.min("h").alias("h")).select(
                F.col("h.hub").alias("hub"), "class")
            members = now.select("key", "class", "n", "rest")
        else:
            pairs = met.select(F.explode(F.transform(apart, lambda h: h["class"])).alias("hub"), "class").distinct()
            members = met.filter(~F.exists("hubs", lambda h: h["class"] == F.col("class"))).select("key", "class", "n", "rest")
        links = _linked(pairs, texts)
        labels = labels if links.isEmpty() else _merged(labels, links)
        turn += 1


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept, text_id, comp.

    ``component_id`` is the smallest doc_id linked with the document, directly or
    through others; ``kept`` marks it. ``comp`` names the component whatever its
    ids are, and is null without shingles; ``text_id`` is a hash of the text.
    """
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    kind = dict(docs.dtypes)["doc_id"]
    sketches = written(docs.mapInArrow(
        _sketch_batches, f"doc_id {kind}, text_id long, n_shingles long, class long, bands array<long>"), "sketches")
    classes = written(
        sketches.filter("n_shingles > 0").groupBy("class").agg(
            F.first("n_shingles").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("rep"),
            F.first("bands").alias("bands")), "classes")
    labels = class_links(classes, docs).drop("central")
    named = classes.select("class", "rep.doc_id").join(labels, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    named = written(named, "named")
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    component = named.join(smallest, "comp").select("class", "comp", "component_id")
    linked = sketches.drop("bands").filter("n_shingles > 0").join(component, "class")
    alone = sketches.drop("bands").filter("n_shingles = 0").withColumns({"comp": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_id", "comp")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: of the smallest id, and of equal ids the first by text hash.

    Rows without shingles all stay.
    """
    rows = written(near_duplicates(documents), "components")
    chosen = rows.filter("comp is not null and kept").groupBy("comp").agg(
        F.min(F.struct("doc_id", "text_id")).alias("k"), F.count(F.lit(1)).alias("same"))
    alone = rows.filter("comp is null").select("doc_id", "text_id", F.lit(1).cast("long").alias("same")).distinct()
    keep = written(chosen.select("k.doc_id", "k.text_id", "same").unionByName(alone).select(
        F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), F.col("same").alias("_same")), "keep")
    keep = _few(keep, keep.count())
    dropped(rows)
    used = ["doc_id", "text"]
    found = aside(documents, used).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")))
    # Only rows that may be repeated as a whole are compared once more.
    once = found.filter("_same = 1")
    many = found.filter("_same > 1").dropDuplicates(["_id", "_text"])
    return once.unionByName(many).select(*back(documents, used))

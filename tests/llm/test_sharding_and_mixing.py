import zlib
from collections import defaultdict

from llm import common
from shelfwise.llm import mixing, sharding
from shelfwise.llm.queries import QUERIES


def check_shards(rows, shards):
    """rows: (order key, size, shard, slot)."""
    by = defaultdict(list)
    for key, size, shard, slot in rows:
        by[shard].append((slot, key, size))
    total, largest = sum(r[1] for r in rows), max(r[1] for r in rows)
    last = None
    for s in sorted(by):
        own = sorted(by[s])
        assert [x[0] for x in own] == list(range(len(own)))
        keys = [x[1] for x in own]
        assert keys == sorted(keys) and (last is None or last <= keys[0])
        last = keys[-1]
        assert abs(sum(x[2] for x in own) - total / shards) <= largest
    assert set(by) <= set(range(shards))


def test_shards_of_awkward_rows(spark):
    df = common.awkward(spark)
    for shards in (1, 3, 40):
        out = sharding.shard_documents(df, shards)
        assert out.columns == [*[c for c in df.columns if c != "shard"], "shard", "slot"]
        rows = out.collect()
        assert len(rows) == df.count()
        check_shards([(-1 if r.doc_id is None else r.doc_id, 16 + len((r.text or "").encode()), r.shard, r.slot) for r in rows], shards)
    assert sharding.shard_documents(common.empty(spark), 4).collect() == []


def test_shard_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op4_sharding"](spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None) for i, t in texts.items()}
    check_shards([(r.doc_id, r.size, r.shard, r.slot) for r in rows], 40)


def targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, out = set(order), sum(sizes.values()), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_by_resharing(spark):
    for sizes in ({"a": 100, "b": 5, "Z": 7, None: 1, "é": 400}, {"a": 10}, {"a": 0, "b": 10, "c": 1}, {"a": 0}, {"x": 1, "y": 1000, "z": 2, "zz": 3}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_mix_of_awkward_rows(spark):
    df = common.awkward(spark)
    rows = mixing.with_copies(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.size == len(common.SPACED.findall(r.text or ""))
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate)) and r.copies <= 3
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed(df.repartition(7)).collect()))
    assert mixing.with_copies(common.empty(spark)).collect() == []


def test_taken_words_come_near_the_targets(spark):
    import random

    rng = random.Random(3)
    values = [common.prose(rng, rng.randrange(5, 60)) for _ in range(3000)]
    sums, goal = defaultdict(int), {}
    for r in mixing.with_copies(common.frame(spark, values)).collect():
        sums[r.source] += r.size * r.copies
        goal[r.source] = r.target
    assert all(abs(sums[s] - goal[s]) < 0.1 * goal[s] for s in goal)


def test_mixing_stays_in_the_jvm(spark, sf_dir):
    plan = QUERIES["op10_source_mixing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

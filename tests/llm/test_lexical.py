import math
import random
from collections import Counter

import numpy as np

from llm import common
from shelfwise.llm import lexical


def brute(docs, items, top=10):
    """docs, items: (id, text); scores of every document for every item."""
    bags = [(i, Counter(common.ALNUM.findall((t or "").translate(common.LOWER)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, terms = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        asked = Counter(common.ALNUM.findall((text or "").translate(common.LOWER)))
        found = []
        for i, b, size in bags:
            m = 100 - 75 + (75 * size * n) // terms
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                        for t, k in asked.items() if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def asked(values):
    rng = random.Random(5)
    items = [(k, " ".join((values[rng.randrange(8, len(values))] or "").split()[:rng.randrange(1, 40)])) for k in range(25)]
    return items + [(3, "w1é W1É w1é w2é"), (30, None), (31, ""), (32, "..."), (None, "w3é w4é"), (33, "unheard of"), (0, items[0][1])]


def result(spark, df, items, **more):
    questions = spark.createDataFrame(items, "item_id long, text string")
    rows = lexical.search(lexical.build(df), questions, **more).collect()
    return sorted([tuple(r) for r in rows], key=str)


def test_every_item_against_all_documents(spark):
    df = common.awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    items = asked(common.texts())
    assert result(spark, df, items) == brute(docs, items)
    assert result(spark, df, items, top=3, block_words=40) == brute(docs, items, 3)


def test_small_pieces_of_a_hot_stratum(spark, monkeypatch):
    rng = random.Random(9)
    values = [common.prose(rng, 30, 60) for _ in range(300)] + [common.prose(rng, 12, 60)] * 200 + [common.prose(rng, 700, 60)]
    df = common.frame(spark, values)
    items = [(k, common.prose(rng, 8, 60)) for k in range(12)]
    want = brute(list(enumerate(values)), items)
    assert result(spark, df, items) == want
    monkeypatch.setattr(lexical, "PIECE_BYTES", 2000)
    index = lexical.build(df)
    assert index.pieces.count() > 20
    rows = lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([tuple(r) for r in rows], key=str) == want


def test_pieces_hold_every_posting(spark):
    df = common.frame(spark)
    index, got = lexical.build(df), Counter()
    for r in index.pieces.collect():
        assert r.terms == sorted(r.terms, key=lambda x: x % (1 << 64))
        for k in range(len(r.terms)):
            entries = range(r.term_at[k], r.term_at[k + 1])
            assert [r.tfs[e] for e in entries] == sorted({r.tfs[e] for e in entries})
            for e in entries:
                for d in r.docs[r.entry_at[e]:r.entry_at[e + 1]]:
                    got[r.ids[d]] += r.tfs[e]
    sizes = {i: len(common.ALNUM.findall(t or "")) for i, t in enumerate(common.texts())}
    assert got == Counter({i: n for i, n in sizes.items() if n})
    assert (index.documents, index.terms) == (len(got), sum(got.values()))


def test_bounds_are_never_below_a_score(spark):
    df = common.frame(spark)
    a = lexical.Asked([t for _, t in asked(common.texts()) if t])
    weights = np.arange(len(a.terms), dtype=np.int64) % 977
    for r in lexical.build(df).pieces.collect():
        lists = [np.array(getattr(r, c), dtype=np.int64) for c in ("terms", "term_at", "tfs", "entry_at", "docs")]
        v = lexical._Visited(a, weights, r.m, *lists, len(r.ids))
        assert all(v.scores(q).max() <= v.bound[q] for q in range(a.n))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1é")], "item_id long, text string")
    assert lexical.search(lexical.build(common.empty(spark)), some).collect() == []
    assert lexical.search(lexical.build(common.frame(spark)), none).collect() == []
    assert lexical.search(lexical.build(common.frame(spark, [None, "", "..."])), some).collect() == []

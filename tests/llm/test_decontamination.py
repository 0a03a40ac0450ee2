import random

from llm import common
from shelfwise.llm import decontamination as D


def brute(text, items):
    words = common.ALNUM.findall((text or "").translate(common.LOWER))
    hit, found = set(), set()
    for item, t in items:
        ws = common.ALNUM.findall((t or "").translate(common.LOWER))
        k = min(len(ws), D.WINDOW)
        for s in range(len(ws) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i:i + k] == ws[s:s + k]:
                    hit |= set(range(i, i + k))
                    found.add(item)
    return len(words), hit, {str(x) for x in found if x is not None}


def case():
    rng = random.Random(5)
    texts = [t for t in common.texts() if t is None or len(t) < 5000]
    long = common.prose(rng, 40)
    items = [(1, texts[12][20:400]), (2, None), (3, ""), (4, "one"), (None, texts[15][:300]), (5, long), (5, long), (6, long[:200]), (7, "Two, ONE")]
    texts += ["x. " + long.upper().replace("É", "é") + " y", "東京 " + long[:120] + " " + long[90:], "two-one ONE two one"]
    return texts, items


def test_hits_match_a_scan(spark):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK_WORDS, 30):  # one automaton, and several
        rows = D.contaminated_words(common.frame(spark, texts), bench, block).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, hit, found = brute(texts[r.doc_id], items)
            assert (r.n_words, {i for h in r.hits for i in range(h.first, h.after)}, set(r.items)) == (n, hit, found)
            assert r.items == sorted(r.items)
            for h, s in zip(r.hits, r.spans, strict=True):
                part = common.ALNUM.findall(texts[r.doc_id][s.start:s.end].translate(common.LOWER))
                assert len(part) == h.after - h.first


def test_awkward_and_empty(spark):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = common.awkward(spark)
    assert D.contaminated_words(df, bench).count() == df.count()
    assert D.contaminated_words(common.empty(spark), bench).collect() == []
    assert all(not r.hits for r in D.contaminated_words(df, bench.filter("false")).collect())
    assert D.clean(df, bench.filter("false")).columns == df.columns
    assert D.clean(df, bench.filter("false")).count() == df.count()


def test_one_block_at_a_time(spark, monkeypatch):
    texts, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    open_now, most, blocks = [], [], []
    sc = type(spark.sparkContext)
    plain = sc.broadcast

    def broadcast(self, value):
        out = plain(self, value)
        open_now.append(out)
        blocks.append(value)
        most.append(len(open_now))
        closes = out.destroy
        out.destroy = lambda *a: (open_now.remove(out), closes(*a))
        return out

    monkeypatch.setattr(sc, "broadcast", broadcast)
    parts, lazy = D._blocks(bench, 30)
    assert parts > 1 and iter(lazy) is lazy
    found = D.contaminated_words(common.frame(spark, texts), bench, 30)
    assert len(blocks) == parts and most == [1] * parts and not open_now
    want = {(i, str(x)) for i, t in enumerate(texts) for x in brute(t, items)[2]}
    assert want and {(r.doc_id, x) for r in found.collect() for x in r.items} == want

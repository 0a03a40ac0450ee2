import hashlib
from itertools import combinations

import numpy as np
from llm import common
from shelfwise.llm import spotsigs as S
from shelfwise.llm.queries import QUERIES


def plain(text):
    """Signatures as tuples of words, word by word."""
    ws = common.ALNUM.findall(text.translate(common.LOWER))
    out = set()
    for i, w in enumerate(ws):
        if w in S.ANCHORS:
            chain = [x for x in ws[i + 1:] if x not in S.ANCHORS][:S.CHAIN]
            if len(chain) == S.CHAIN:
                out.add((w, *chain))
    if not out and ws:
        k = min(S.CHAIN, len(ws))
        out = {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)}
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(order, rows):
    """order: the texts in their order; rows: their results in that order."""
    assert len(order) == len(rows)
    for i, r in enumerate(rows):
        t, f = order[i] or "", order[(i + 1) % len(order)] or ""
        e = S.edited(t, f)
        assert len(e) == len(t) - len(t) // 2 + min(len(t) // 2, len(f))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(plain(t)) and len(r.edited_fingerprint) == 8 * len(plain(e))
        assert abs(r.near_edited - jaccard(plain(t), plain(e))) < 1e-9
        assert abs(r.near_next - jaccard(plain(t), plain(f))) < 1e-9


def test_neighbours_in_order_of_ids(spark):
    values = common.texts() + ["the cat sat on the mat with a very old dog and the cat"] * 2
    ids = [(i * 37) % 1009 - 300 for i in range(len(values))]
    rows = sorted(S.edited_neighbours(common.frame(spark, values, ids).repartition(5)).collect(), key=lambda r: r.doc_id)
    check([values[ids.index(r.doc_id)] for r in rows], rows)
    same = {}
    for r in rows:
        same.setdefault(values[ids.index(r.doc_id)] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_awkward_and_empty(spark):
    df = common.awkward(spark)
    rows = S.edited_neighbours(df).collect()
    assert len(rows) == df.count() and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert S.edited_neighbours(common.empty(spark)).collect() == []
    one = S.edited_neighbours(common.frame(spark, ["the one two three four"], [5])).collect()
    check(["the one two three four"], one)


def test_query_over_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(QUERIES["op5_spotsigs_fingerprint"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    check([texts[r.doc_id] for r in rows], rows)


def test_pruned_comparison_and_partitions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint32)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 60, rng.integers(0, 10))])).astype(np.uint32)
        full = S.likeness(a, b)
        assert S.likeness(a, b, 0.6) == (full if full >= 0.6 else 0.0)
        if len(a) and len(b) and full >= 0.6:
            assert abs(int(S.length_partition(len(a), 0.6)) - int(S.length_partition(len(b), 0.6))) <= 1
        assert (S.parse(S.fingerprint(a)) == a).all()


def all_near(spark, df, least):
    """The pairs that near_sets finds, as rows of documents, against all pairs compared."""
    members, pairs = S.near_sets(df, least)
    of = {r.doc_id: r.set for r in members.collect()}
    found = {(r.a, r.b): r.near for r in pairs.collect()}
    assert len(found) == pairs.count() and all(a < b for a, b in found)
    texts = {r.doc_id: plain(r.text or "") for r in df.collect()}
    assert set(of) == set(texts)
    want = {}
    for x, y in combinations(texts, 2):
        near = jaccard(texts[x], texts[y])
        assert (of[x] == of[y]) == (texts[x] == texts[y])
        if near >= least and of[x] != of[y]:
            want[min(of[x], of[y]), max(of[x], of[y])] = near
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    return len(want)


def test_all_near_sets_wherever_they_stand(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = common.texts()
    for n in (5, 12, 40, 60):  # sizes around the bounds of partitions, and a signature that many sets hold
        ws = [f"the x{k}y a z{k} q{k}" for k in range(n)]
        for _ in range(8):
            values.append("the very common line here. " + " ".join(w for w in ws if rng.random() < 0.9))
            values.append(" ".join(ws[: int(rng.integers(n // 2, n + 1))]))
    ids = [(i * 37) % 1009 - 300 for i in range(len(values))]
    df = common.frame(spark, values, ids).repartition(5)
    counts = [all_near(spark, df, least) for least in (0.55, 0.8)]
    assert counts[0] > counts[1] > 20
    monkeypatch.setattr(S, "CELL", 3)
    monkeypatch.setattr(S, "STEP", 4)
    assert all_near(spark, df, 0.55) == counts[0]


def test_near_sets_of_awkward_and_empty(spark):
    df = common.awkward(spark)
    members, pairs = S.near_sets(df, 0.5)
    assert members.count() == df.count()
    assert len({r.set for r in members.collect() if r.n == 0}) == 1
    members, pairs = S.near_sets(common.empty(spark), 0.5)
    assert members.collect() == [] and pairs.collect() == []


def test_comparison_stops_early(monkeypatch):
    looked = []
    search = np.searchsorted
    monkeypatch.setattr(S.np, "searchsorted", lambda b, x, **k: looked.append(np.size(x)) or search(b, x, **k))
    a = np.arange(0, 20000, 2, dtype=np.uint32)
    assert S.likeness(a, a + np.uint32(1), 0.9) == 0.0 and sum(looked) < 2000
    assert S.likeness(np.arange(55, dtype=np.uint32), np.arange(100, dtype=np.uint32), 0.55) == 0.55

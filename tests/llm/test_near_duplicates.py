import numpy as np
from llm import common
from shelfwise.llm import minhash, words


def sets(values):
    out = []
    for t in values:
        w = common.SPACED.findall((t or "").translate(common.LOWER))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, values):
    s = sets(values)
    low = list(range(len(s)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                low[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(s)):
        groups.setdefault(root(i), []).append(ids[i])
    return [(ids[i], len(s[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i in range(len(s))]


def test_components_match_all_pairs(spark):
    df = common.awkward(spark)
    data = df.select("doc_id", "text").collect()
    got = minhash.near_duplicates(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = brute([r.doc_id for r in data], [r.text for r in data])
    # Rows without shingles are linked with nothing, whatever ids repeat.
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_links_and_a_large_group(spark):
    """Copies of which neighbours are similar and the ends are not; and many copies of one text."""
    ws = [f"a{i}" for i in range(60)]
    chain = []
    for step in range(30):
        ws = ws[1:] + [f"b{step}"]
        chain.append(" ".join(ws))
    base = [f"c{i}" for i in range(80)]
    group = [" ".join([*base[:k], "x", *base[k + 1:]]) for k in range(80)] * 3
    values = chain + group
    got = minhash.near_duplicates(common.frame(spark, values)).collect()
    want = {i: c for i, _, c in brute(list(range(len(values))), values)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len({want[i] for i in range(30)}) == 1


def test_texts_that_share_a_passage_are_dealt_by_their_rare_shingles(spark):
    """A passage of 60 words with 6 to 30 of its own words around: some are linked, most meet in buckets only."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    values = []
    for i in range(240):
        own = [f"w{x}" for x in rng.integers(0, 40 if i % 3 else 4000, int(rng.integers(6, 30)))]
        cut = int(rng.integers(0, len(own) + 1))
        values.append(" ".join([*own[:cut], *passage, *own[cut:]]))
    values += [v.replace("p30", "other") for v in values[::4]]
    got = minhash.near_duplicates(common.frame(spark, values)).collect()
    want = {i: c for i, _, c in brute(list(range(len(values))), values)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert 20 < len(set(want.values())) < 200


def test_rare_buckets_hold_every_similar_pair(spark):
    rng = np.random.default_rng(6)
    base = [[f"v{x}" for x in rng.integers(0, 300, 60)] for _ in range(12)]
    values = [" ".join(b[:k] + [f"y{k}"] + b[k + 2:]) for b in base for k in range(0, 56, 8)]
    texts = spark.createDataFrame(list(enumerate(values)), "class long, text string")
    rows = minhash._rare_buckets(texts.select("class"), texts).collect()
    met, s = {}, sets(values)
    for r in rows:
        assert r.n == len(s[r["class"]]) >= r.rest >= 1
        met.setdefault(r.key, []).append(r)
    found = {(a["class"], b["class"]) for group in met.values() for a in group for b in group
             if a["class"] < b["class"] and 175 * min(a.rest, b.rest) >= 75 * (a.n + b.n)}
    similar = {(i, j) for j in range(len(s)) for i in range(j) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])}
    assert similar and similar <= found


def test_one_document_of_each_group_stays(spark):
    df = common.awkward(spark)
    kept = minhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    left = kept.collect()
    again = {r.component_id for r in minhash.near_duplicates(df).collect() if r.n_shingles}
    full = [r for r in left if r.text and r.text.split()]
    assert sorted(r.doc_id for r in full if r.doc_id is not None) == sorted(x for x in again if x is not None)
    assert sum(not (r.text and r.text.split()) for r in left) == sum(not (r.text and r.text.split()) for r in df.collect())


def test_empty_table(spark):
    assert minhash.near_duplicates(common.empty(spark)).collect() == []
    assert minhash.without_near_duplicates(common.empty(spark)).collect() == []


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    s = minhash.sketch([a, b, pool[:1], np.zeros(0, np.uint64)])
    assert (s[:3] != minhash._MAX).all() and (s[3] == minhash._MAX).all()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.15


def test_words_agree_with_a_regular_expression():
    import pyarrow as pa

    values = common.texts()
    for keep, pattern in ((words.NOT_SPACE, common.SPACED), (words.ALNUM, common.ALNUM)):
        w = words.words_of(pa.array(values, pa.string()), keep)
        got = [[w.text(i).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(len(values))]
        assert got == [pattern.findall((v or "").translate(common.LOWER)) for v in values]
        flat = [x for r in got for x in r]
        h = w.hashes()
        assert len(set(h.tolist())) == len(set(flat)) == len({(x, int(y)) for x, y in zip(flat, h)})

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm import common
from pyspark.sql import functions as F
from shelfwise.llm import language_model as L
from shelfwise.llm import languages as I
from shelfwise.llm import toxicity as X
from shelfwise.llm.queries import QUERIES


def test_language_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = I.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, keep, label = rng.integers(97, 101, (6, 4)).astype(np.uint8), rng.random((6, 4)) < 0.8, np.array([0, 1, 2, 1])

    def loss():
        p = net.probabilities(net.states(data, keep).astype(np.float64))
        return -(np.log(p[:, np.arange(4), label]) * keep).sum() / keep.sum()

    g = net.gradients(data, keep, label)
    for k, at in (("u", (0, 2, 5)), ("u", (1, 3, 20)), ("x", (0, 98, 3)), ("x", (1, 99, 18)), ("o", (1, 4, 2)), ("b", (1,))):
        old, d = net.p[k][at], 1e-2
        net.p[k][at] = old + d
        up = loss()
        net.p[k][at] = old - d
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * d) - g[k][at]) < 2e-3


def test_language_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    df = common.awkward(spark)
    net = I.fit(df, F.lit(True), 20)
    rows = I.predict(df, net).collect()
    assert len(rows) == df.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and (lettered or r.score == 0)
    assert I.accepted(df, net).columns == df.columns
    assert I.fit(common.empty(spark), F.lit(True)) is None and I.fit(df, F.lit(False)) is None
    assert {r.lang_pred for r in I.predict(df, None).collect()} == {"und"}
    assert I.predict(common.empty(spark), net).collect() == []


def test_every_byte_counts():
    net = I.Network(["a", "b"])
    values = ["x" * n for n in (0, 1, 127, 128, 129, 1000)] + ["é東" * 100]
    p = I.pooled(net, pa.array(values))
    assert np.allclose(p[1:].sum(axis=1), 1, atol=1e-5) and (p[0] == 0).all()
    assert np.allclose(p[3], I.pooled(net, pa.array(["x" * 128] * 2))[0])


def toxic_case(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = common.prose(rng, rng.randrange(10, 200)).split(" ")
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["Vile", "rotten!", "fiend" + rng.choice("abc")]))
        out.append(" ".join(ws))
    return out


def test_toxic_words_are_found(spark):
    texts = toxic_case(1, 400) + toxic_case(2, 400)[:200] + common.texts()
    df = common.frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = X.fit(df, labels, F.col("doc_id") < 400)
    rows = {r.doc_id: r for r in X.score(df, model).collect()}
    assert len(rows) == len(texts)
    for i in range(400, 600):
        assert (rows[i].score >= 0.5) == (i % 4 == 0)
        words = [texts[i][s.start:s.end].lower() for s in rows[i].spans]
        assert all(any(t in w for t in ("vile", "rotten", "fiend")) for w in words) and bool(words) == (i % 4 == 0)
    assert all(rows[i].score < 0.5 for i in range(600, len(texts)))
    assert rows[600].score == 0 and rows[601].score == 0


def test_the_sample_is_bounded_by_bytes_and_holds_a_row_once():
    rows = [{"doc_id": i, "key": i, "toxic": int(i % 2), "size": n} for i, n in enumerate((40, 50, 70, 60, 30, 900, 30))]
    assert X.within(rows, 100) == [(0, 0), (1, 1), (4, 4), (6, 6)]
    assert X.within(rows, 0) == X.within([], 100) == []


def test_repeated_rows_do_not_push_other_documents_out_of_the_sample(spark):
    texts = toxic_case(1, 200)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    once = common.frame(spark, texts)
    # One clean document a third of all rows and more, and a column of the labels' name.
    hot = once.unionByName(common.frame(spark, texts).filter("doc_id = 1").crossJoin(spark.range(300)).drop("id")).withColumn("toxic", F.lit("x"))
    models = [X.fit(d, labels, F.lit(True), sample=50) for d in (once, hot)]
    scores = [[r.score for r in X.score(once, m).orderBy("doc_id").collect()] for m in models]
    assert scores[0] == scores[1] and max(scores[0]) > 0.5
    assert X.fit(once, labels, F.lit(True), sample_bytes=10) is None


def test_toxicity_of_awkward_rows(spark):
    df, none = common.awkward(spark), spark.createDataFrame([], "doc_id long, toxic int")
    assert X.fit(df, none, F.lit(True)) is None
    rows = X.score(df, None).collect()
    assert len(rows) == df.count() and {r.score for r in rows} == {0.0}
    assert X.score(common.empty(spark), None).collect() == []
    assert X.score(df, X.Crf()).count() == df.count()


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    crf = X.Crf()
    crf.t, crf.start = rng.standard_normal((2, 2)), 0.3
    e, n = rng.standard_normal((X.CHAIN, 2)), 7
    keep = np.arange(X.CHAIN)[:, None] < np.array([n, n - 3])
    got = crf.marginals(np.where(keep, e, 0.0), keep)
    for row, size in ((0, n), (1, n - 3)):
        total, ones = 0.0, np.zeros(size)
        for bits in range(1 << size):
            y = [(bits >> k) & 1 for k in range(size)]
            s = crf.start * y[0] + sum(e[k, row] * y[k] for k in range(size)) + sum(crf.t[a, b] for a, b in zip(y, y[1:]))
            total += math.exp(s)
            ones += np.array(y) * math.exp(s)
        assert np.allclose(got[:size, row], ones / total)


def brute_base(texts, learn):
    tokens = [[*common.SPACED.findall((t or "").translate(common.LOWER)), None] for t in texts]
    c = Counter(w for ws, use in zip(tokens, learn) if use for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens]


def compare_base(rows, want):
    for r, w in zip(rows, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert abs(r.base_score - w[3]) < 1e-6 * max(1, abs(w[3]))


def test_counts_and_base_scores(spark):
    df = common.frame(spark)
    data = df.orderBy("doc_id").collect()
    want = brute_base([r.text for r in data], [r.doc_id % 3 != 0 for r in data])
    for head in (L.HEAD, 40, 0):  # all counts broadcast, some, none
        model, counts = L.fit(df.filter("doc_id % 3 != 0").select("text"), head=head)
        compare_base(sorted(L.scored(df, model, counts).collect(), key=lambda r: r.doc_id), want)


def test_language_model_over_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(QUERIES["op8_language_model"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    ids = sorted(texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    compare_base(rows, brute_base([texts[i] for i in ids], [not h for h in held]))
    assert [r.held_out for r in rows] == held
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_probabilities_add_up():
    rng = np.random.default_rng(0)
    w = rng.standard_normal(L.start_weights().shape).astype(np.float32)
    p = np.exp(L.log_classes(w, L.Tokens(pa.array(["a b c d", "", "e"])).features()))
    assert p.shape == (8, L.CLASSES) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_language_model_of_awkward_rows(spark):
    df = common.awkward(spark)
    assert L.score_documents(df, F.lit(True)).count() == df.count()
    nothing = L.score_documents(df, F.lit(False)).collect()
    assert len(nothing) == df.count() and {r.train_tokens for r in nothing} == {0} and {r.n_known for r in nothing} == {0}
    assert L.score_documents(common.empty(spark), F.lit(True)).collect() == []


def test_every_language_and_window_is_learned(spark, monkeypatch):
    rows = [(i, f"text {i} " * 3, f"l{i % 210:03}") for i in range(630)]
    net = I.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), 1)
    assert net.languages == [f"l{i:03}" for i in range(210)]
    read = Counter()
    net = I.Network(["a"])
    monkeypatch.setattr(I.Network, "gradients", lambda self, data, keep, label: read.update(label.tolist()) or {k: np.zeros_like(v) for k, v in self.p.items()})
    n = 50_030
    net.train(np.zeros((1, n), np.uint8), np.ones((1, n), bool), np.arange(n))
    assert len(read) == n and min(read.values()) >= I.PASSES - 1


def test_accepted_documents_are_as_they_were(spark):
    df = common.frame(spark)
    letters = {r.doc_id for r in df.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in I.accepted(df, None).collect()} == letters
    kept = I.accepted(df, I.Network([str(i) for i in range(50)]))  # nothing learned, no label has 0.3
    assert {r.doc_id for r in kept.collect()} == letters
    assert kept.schema == df.schema and {r.score for r in kept.collect()} == {"x"}


def test_toxic_span_at_the_end_of_a_long_document_teaches(spark):
    rng = random.Random(6)

    def text(toxic):
        end = " ".join(f"{common.prose(rng, 2)} {rng.choice(['vile', 'rotten'])}" for _ in range(4)) if toxic else ""
        return f"{common.prose(rng, 9000)} {end} {common.prose(rng, 3)}"

    marks = [i % 3 == 0 for i in range(36)]
    df = common.frame(spark, [text(m) for m in marks])
    assert df.selectExpr("min(length(text))").first()[0] > 40_000
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks) if i < 30], "doc_id long, toxic int")
    model = X.fit(df, labels, F.lit(True))
    assert model is not None
    rows = {r.doc_id: r for r in X.score(df, model).collect()}
    assert [rows[i].score >= 0.5 for i in range(30, 36)] == marks[30:]
    assert all(len(rows[i].spans) >= 4 for i in (30, 33))


def test_language_gradients_of_rows_that_lie_last():
    rng = np.random.default_rng(3)
    net = I.Network(["a", "b", "c"])
    data, label = rng.integers(97, 110, (40, 9)).astype(np.uint8), rng.integers(0, 3, 9)
    for keep in (np.ones((40, 9), bool), np.arange(40)[:, None] < rng.integers(1, 41, 9)):
        want = net.gradients(data, keep, label)
        got = net.gradient_sums(data, keep, label, np.full(9, 1 / keep.sum()))
        assert all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-6) for k in want)


def test_all_bytes_of_all_labelled_rows_teach(spark):
    """The network of the pipeline learned from a bounded sample of windows."""
    rng = random.Random(8)
    rows = [(i, common.prose(rng, rng.choice([1, 30, 400])), rng.choice("abb")) for i in range(70)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "no id here", "a"), (900, "unlabelled", None), (901, "", "a")], "doc_id long, text string, lang string")
    labelled = docs.filter("lang IS NOT NULL AND length(text) > 0")
    net, shares = I.Network(["a", "b"]), {"a": 2.0, "b": 0.5}
    sums = [I._summed_gradients(net, labelled.repartition(n), shares) for n in (1, 5)]
    taught = [*rows, rows[0], (None, "no id here", "a")]
    data, keep, doc = I.segments(*I.words.text_bytes(pa.array([t for _, t, _ in taught])))
    label = np.array([net.languages.index(x) for _, _, x in taught])[doc]
    want = net.gradient_sums(data, keep, label, np.array([2.0, 0.5])[label])
    for g, total in sums:
        assert total == sum(len(t.encode()) * shares[x] for _, t, x in taught)
        assert all(np.allclose(g[k], want[k], rtol=1e-3, atol=1e-2) for k in want)
    assert I._summed_gradients(net, labelled.limit(0), shares) == ({}, 0.0)
    # A row that gives no window to the sample teaches.
    more = docs.unionByName(spark.createDataFrame([(5000 + i, common.prose(rng, 300), "b") for i in range(200)], docs.schema))
    part, whole = (I.fit(more, F.lit(True), 2, whole=w) for w in (False, True))
    again = I.fit(more, F.lit(True), 2)
    assert all((again.p[k] == whole.p[k]).all() and (part.p[k] != whole.p[k]).any() for k in part.p)


def test_prediction_of_rows_that_lie_last():
    """What the pipeline predicts with agrees with op6's prediction."""
    rng = random.Random(2)
    net = I.Network(["a", "b", "c"])
    for values in (["", "x", "é東" * 200, *(common.prose(rng, n) for n in (1, 40, 3000))], [], [None, ""]):
        column = pa.array(values, pa.string())
        assert np.allclose(I._pooled_whole(net, column), I.pooled(net, column), rtol=1e-5, atol=1e-6)

import hashlib
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from llm import common, test_decontamination, test_near_duplicates, test_sharding_and_mixing
from pyspark.sql import functions as F


def test_stages_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    assert all(r.n == r["last"] + 1 for r in rows)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, common.texts()[12][:200])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for df in (common.awkward(spark), common.empty(spark)):
        docs = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            docs = stage(spark, docs, folder)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == before
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_columns_of_any_name_pass_every_stage(spark, tmp_path):
    """Names that operators use inside, carried through all stages with their values."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, "w1é w2é w3é")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = ["_id", "_text", "_same", "_source", "_rate", "_copy", "__size", "__row", "__part", "__at", "kept0", "kept1", "class", "comp", "piece",
             "t", "r", "copies", "hits", "n_words", "items", "spans", "lang_pred", "score", "size", "target", "source_size", "text_id", "_url"]
    docs = common.frame(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumns(
        {n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns == [*docs.columns, *(["shard", "slot"] if k == 4 else [])], name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names), name
        docs = spark.createDataFrame(rows, out.schema)


def test_clean_documents_stay(spark):
    import random

    rng = random.Random(4)
    clean = common.frame(spark, [common.prose(rng, 60, 100000) for _ in range(40)])
    bench = spark.createDataFrame([(1, common.prose(rng, 30, 100000))], "item_id long, text string")
    from shelfwise.llm import decontamination, languages, minhash

    assert minhash.without_near_duplicates(clean).count() == 40
    assert decontamination.clean(clean, bench).count() == 40
    assert languages.accepted(clean, languages.fit(clean, F.lit(True), 30)).count() == 40


def brute_languages(spark, docs, rows, items):
    from shelfwise.llm import languages

    net = languages.fit(docs, F.lit(True))
    text = lambda r: r.text or ""
    return [r for r in rows if any(c.isalpha() for c in text(r)) and languages.pooled(net, pa.array([r.text])).max() >= net.least]


def brute_near(spark, docs, rows, items):
    found = test_near_duplicates.brute([r.doc_id for r in rows], [r.text for r in rows])
    return [r for r, (doc, n, component) in zip(rows, found, strict=True) if n == 0 or doc == component]


def brute_clean(spark, docs, rows, items):
    return [r for r in rows if not test_decontamination.brute(r.text, items)[1]]


def brute_mix(spark, docs, rows, items):
    sizes, words = Counter(), lambda r: len(common.SPACED.findall(r.text or ""))
    for r in rows:
        sizes[r.source] += words(r)
    goal = test_sharding_and_mixing.targets(dict(sizes))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    out = []
    for r in rows:
        rate = goal[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        drawn = int(md5(f"7|{r.doc_id}|{md5(r.text or '')}")[:13], 16) / 2**52
        out += [r] * (int(rate) + (drawn < rate - int(rate)))
    return out


def test_every_stage_matches_brute_force_on_its_input(spark, tmp_path):
    texts, items = test_decontamination.case()
    folder = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = common.frame(spark, texts, [(i * 37) % 1009 - 300 for i in range(len(texts))])
    counts = [len(texts)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, [brute_languages, brute_near, brute_clean, brute_mix]):
        rows = docs.collect()
        want = Counter(brute(spark, docs, rows, items))
        got = stage(spark, docs, folder)
        assert got.dtypes == docs.dtypes, name
        assert Counter(got.collect()) == want, name
        counts.append(sum(want.values()))
        docs = spark.createDataFrame(got.collect(), got.schema)
    assert counts[0] > counts[1] > counts[2] > counts[3] > 20 and counts[4] > 20
    name, stage = corpus_pipeline.STAGES[4]
    rows, out = docs.collect(), stage(spark, docs, folder).collect()
    plain = lambda rs: Counter((r.doc_id, r.text, r.lang, r.source) for r in rs)
    assert name == "sharding" and plain(out) == plain(rows)
    test_sharding_and_mixing.check_shards(
        [(r.doc_id, 16 + len((r.text or "").encode()), r.shard, r.slot) for r in out], corpus_pipeline.SHARDS)


def test_texts_in_no_language_go(spark):
    """The threshold was below chance when languages are few, so that no text with a letter could fall below it."""
    import random

    from shelfwise.llm import languages

    rng = random.Random(6)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, words("abcdef" if i % 2 else "uvwxyz", 60), "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(-1 - i, words("abcdef", 30) + " " + words("uvwxyz", 30), None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = languages.fit(docs, F.lit(True))
    assert net.least > 1 / len(net.languages)
    assert sorted(r.doc_id for r in languages.accepted(docs, net).select("doc_id").collect()) == list(range(60))

from llm import common
from shelfwise.llm import licenses
from shelfwise.llm.queries import QUERIES


def places(text):
    w = common.ALNUM.findall((text or "").translate(common.LOWER))
    out = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), sorted(out)


TEXTS = [
    None, "", "CC BY", "cc-by cc by CC  BY, All Rights Reserved. all rights all rights reserved", "cc", "by cc", "general public general public license",
    "This work is licensed under the GNU General Public License, version 3. " * 2, "x " * 5000 + "all rights reserved " + "y " * 5000,
    "Released under the brand new MIT License.", "released under license", "permission is granted free of charge to any person obtaining a copy of this software",
]


def test_places_match_a_scan(spark):
    found = licenses.license_spans(common.frame(spark, TEXTS + TEXTS[:4])).collect()
    assert len(found) == len(TEXTS) + 4
    for r in found:
        text = (TEXTS + TEXTS[:4])[r.doc_id]
        assert (r.n_words, sorted((s.first, s.label) for s in r.found if s.phrase)) == places(text)


def test_statements_with_changes(spark):
    labels = {r.doc_id: {s.label for s in r.found if not s.phrase} for r in licenses.license_spans(common.frame(spark, TEXTS)).collect()}
    assert labels[7] == {"gpl-3.0"} and labels[9] == {"mit"} and labels[11] == {"mit"}
    assert not labels[10] and not labels[0] and not labels[2]


def test_awkward_and_empty(spark):
    df = common.awkward(spark)
    assert licenses.license_spans(df).count() == df.count()
    assert licenses.license_spans(common.empty(spark)).collect() == []


def test_query_against_a_scan_of_the_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op2_license_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, found = places(texts[r.doc_id])
        starts = [i for i, _ in found]
        want = (n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1

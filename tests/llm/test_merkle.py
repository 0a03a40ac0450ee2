import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from llm import common
from shelfwise.llm import merkle
from shelfwise.llm.queries import QUERIES


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def trees(leaves, arity):
    """Root of a list of digests, and for every leaf the (before, after) texts per level."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            run, slot = runs[i // arity], i % arity
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1:])))
        level, at = [digest("".join(r)) for r in runs], [i // arity for i in at]
    return level[0], paths


def brute(rows, arity=2):
    """rows: (group, order, leaf) to sorted (group, order, leaf, subroot, path), and the root."""
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted([r for r in rows if r[0] == g], key=lambda r: (first(r[1]), r[2])) for g in groups}
    inner = {g: trees([r[2] for r in own[g]], arity) for g in groups}
    root, outer = trees([inner[g][0] for g in groups], arity)
    return sorted([(r[0], r[1], r[2], inner[g][0], inner[g][1][k] + outer[n])
                   for n, g in enumerate(groups) for k, r in enumerate(own[g])], key=str), root


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("shuffled", [False, True])
def test_manifest_against_lists(spark, monkeypatch, arity, shuffled):
    if shuffled:
        monkeypatch.setattr(merkle, "BROADCAST_NODES", -1)
        monkeypatch.setattr(merkle, "BROADCAST_BYTES", -1)
    df = common.awkward(spark).unionByName(common.frame(spark, ["alone"], [500]).withColumn("lang", F.lit("zz")))
    made = merkle.build(df, F.col("lang"), F.col("doc_id"), merkle.leaf(F.col("doc_id"), F.col("text")), ["lang", "doc_id"], arity)
    want, root = brute([(r.lang, r.doc_id, leaf(r.doc_id, r.text)) for r in df.collect()], arity)
    got = made.leaves.withColumns({"folded": merkle.folded(F.col("leaf")), "proof": merkle.proof()}).collect()
    assert made.root == root and {r.folded for r in got} == {root}
    assert sorted([(r.lang, r.doc_id, r.leaf.hex(), r.subroot.hex(), [(p.left.hex(), p.right.hex()) for p in r.path]) for r in got], key=str) == want
    assert all(r.proof == "".join(p.left.hex() + p.right.hex() for p in r.path) for r in got)


def test_small_and_empty_tables(spark):
    build = lambda df: merkle.build(df, F.col("lang"), F.col("doc_id"), merkle.leaf(F.col("text")), ["doc_id"])
    assert build(common.empty(spark)).leaves.collect() == [] and build(common.empty(spark)).root is None
    one = build(common.frame(spark, ["only"]))
    row = one.leaves.first()
    assert one.root == leaf("only") == row.leaf.hex() == row.subroot.hex() and row.path == []
    with pytest.raises(ValueError):
        merkle.build(common.frame(spark), F.col("lang"), F.col("doc_id"), merkle.leaf(F.col("text")), [], 1)


def test_manifest_query(spark, sf_dir, tmp_path):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*names).limit(60)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "xx", 0, ""), (None, "a", "en", 3, "né\n")], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.unionByName(odd).collect()]
    want, root = brute([(r[2], r[0], leaf(*r)) for r in rows])
    changed = {r[0]: leaf(*r[:3], r[3] + 1, r[4]) for r in rows if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert changed
    expected = []
    for _, i, own, subroot, path in want:
        h = changed.get(i, own)
        for before, after in path:
            h = digest(before + h + after)
        expected.append((i, own, subroot, root, digest("".join(b + a for b, a in path)), h, h == root))
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert {x[0] for x in expected if not x[-1]} == set(changed)

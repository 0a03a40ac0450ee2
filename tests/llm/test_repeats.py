import hashlib
import random
from collections import Counter

import numpy as np
from llm import common
from shelfwise.llm import repeats as R


def brute(texts, keep_first=False):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + R.LENGTH] for b in data for p in range(len(b) - R.LENGTH + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - R.LENGTH + 1):
            if seen[b[p:p + R.LENGTH]] > 1:
                gone[p:p + R.LENGTH] = b"\1" * R.LENGTH
        runs = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(b), sum(gone), len(runs), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return out


def case():
    rng = random.Random(9)
    passages = [common.prose(rng, n) for n in (70, 62, 200)]
    texts = [t for t in common.texts() if t is None or len(t) < 9000]
    for k in range(25):
        p = passages[k % 3]
        cut = rng.randrange(0, 80)
        texts.append(common.prose(rng, rng.randrange(0, 60)) + " " + p[cut:] + common.prose(rng, rng.randrange(0, 60)))
    texts += ["ab" * 600, "x" * 399, "x" * 400, "x" * 401, "é" * 300, passages[2] + passages[2], passages[0] * 3]
    block = common.prose(rng, 80)[:R.LENGTH]
    return texts + [block + "1" + block[1:], "2" + block, block[:-1] + "3"]


def test_removed_bytes_match_all_windows(spark, monkeypatch):
    texts = case()
    want = brute(texts)
    for group in (R.GROUP, 2):  # groups in one task; groups split into their windows
        monkeypatch.setattr(R, "GROUP", group)
        rows = sorted(R.without_repeats(common.frame(spark, texts)).collect(), key=lambda r: r.doc_id)
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want


def test_stretches_and_joins_without_broadcast_change_nothing(spark, monkeypatch):
    texts = case()
    monkeypatch.setattr(R, "_PLACE_BITS", 10)  # texts longer than a place has bits
    monkeypatch.setattr(R, "BROADCAST_BYTES", -1)
    rows = sorted(R.without_repeats(common.frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)
    grams = np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1)
    want = [p + int(np.argmin(grams[p:p + R.LEFT + 1] >> np.uint64(10))) for p in range(len(grams) - R.LEFT)]
    assert R.smallest_places(grams).tolist() == want


def test_one_copy_stays(spark, monkeypatch):
    """With keep_first every repeated window still stands once in what is left, or overlaps a removed copy."""
    rng = random.Random(2)
    parts = [common.prose(rng, 90) for _ in range(4)]
    texts = [parts[0] + "|" + parts[1], parts[1] + "|" + parts[2], parts[0], parts[0], parts[3]]
    for group in (R.GROUP, 1):
        monkeypatch.setattr(R, "GROUP", group)
        rows = {r.doc_id: r for r in R.without_repeats(common.frame(spark, texts), keep_first=True).collect()}
        kept = []
        for i, t in enumerate(texts):
            b, at = t.encode(), 0
            for s in rows[i].removed:
                kept.append(b[at:s.start])
                at = s.end
            kept.append(b[at:])
        assert [sum(p.encode() in k for k in kept) for p in parts] == [1, 1, 1, 1]


def test_awkward_and_empty(spark):
    df = common.awkward(spark)
    rows = R.without_repeats(df).collect()
    data = df.collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(brute([r.text for r in data]))
    assert R.without_repeats(common.empty(spark)).collect() == []


def test_common_prefixes_decide_without_hashes(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(R.words, "mix", lambda x: np.zeros_like(x))  # all hashes are equal
    base = rng.integers(97, 99, R.LEFT + R.LENGTH).astype(np.uint8)
    rows = []
    for _ in range(60):
        own = base.copy()
        for at in rng.integers(0, len(own), rng.integers(0, 3)):
            own[at] ^= 3
        low, high = int(rng.integers(0, R.LEFT)), int(rng.integers(R.LEFT + R.KGRAM, len(own) + 1))
        rows.append((R.LEFT - low, own[low:high].tobytes()))
    pieces, rank = R.Pieces(rows), rng.permutation(len(rows))
    any_copy, later = np.zeros((2, len(rows), R.LEFT + 1), dtype=bool)
    for before in range(R.LEFT + 1):
        same = {}
        for i, (b, piece) in enumerate(rows):
            if before <= b and b - before + R.LENGTH <= len(piece):
                same.setdefault(piece[b - before:b - before + R.LENGTH], []).append(i)
        for who in same.values():
            any_copy[who, before] = len(who) > 1
            later[[i for i in who if rank[i] > min(rank[who])], before] = True
    assert 0 < later.sum() < any_copy.sum() < any_copy.size
    assert (R.repeated_windows(pieces, rank, False) == any_copy).all()
    assert (R.repeated_windows(pieces, rank, True) == later).all()


def test_ranges_are_split_only_while_many_share_them(spark, monkeypatch):
    """Large groups were split down to single windows, however few different ranges were left in them."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = letters(800), [letters(150) for _ in range(3)]
    texts = [passage + tails[i % 3] + letters(300) for i in range(12)]
    turns, nodes = [], R._node_batches
    monkeypatch.setattr(R, "_node_batches", lambda width: turns.append(width) or nodes(width))
    monkeypatch.setattr(R, "GROUP", 8)
    rows = sorted(R.without_repeats(common.frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts)
    assert turns and min(turns) > 40

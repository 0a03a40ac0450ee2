"""Small documents with the awkward cases every operator must handle."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, shard int, hits int, class string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}é{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    """Copies, near copies, shared passages, nulls, empties, very short and very long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(20, 150)) for _ in range(25)]
    out: list[str | None] = [None, "", "   \n\t ", "one", "One two", "...", "ÀÉ 東京 日本", prose(rng, 9000, 5000)]
    out += base + base[:6]
    for t in base[:10]:
        for _ in range(3):
            ws = t.split(" ")
            ws[rng.randrange(len(ws))] = "changed"
            out.append(" ".join(ws))
    passage = prose(rng, 90)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 40) for _ in range(6)]
    return out


def rows(values=None, ids=None) -> list[tuple]:
    values = texts() if values is None else values
    ids = range(len(values)) if ids is None else ids
    langs, sources = ["en", "de", None], ["a", "b", "Z", None, "a"]
    return [(i, t, langs[k % 3], sources[k % 5], len(t or ""), "x", "y", 3, 4, "z") for k, (i, t) in enumerate(zip(ids, values))]


def frame(spark, values=None, ids=None):
    return spark.createDataFrame(rows(values, ids), SCHEMA)


def awkward(spark):
    """Repeated rows and null ids besides the usual ones."""
    r = rows()
    return spark.createDataFrame([*r, *r[:12], (None, r[10][1], *r[10][2:]), (None, None, *r[0][2:]), (None, "one more", *r[0][2:])], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

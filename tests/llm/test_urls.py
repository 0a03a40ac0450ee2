import random
import re

import numpy as np
import pyarrow as pa

from shelfwise.llm import urls, words
from shelfwise.llm.queries import _GLOBS, _SITES, QUERIES

SITES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def regex(glob):
    part = {"**": "(?s:.)*", "*": "[^/]*", "?": "(?s:.)"}
    return re.compile("".join(part.get(x) or re.escape(x) for x in re.findall(r"\*\*|\*|\?|[^*?]", glob, re.S)) + r"\Z")


def holds(globs, texts):
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    return urls.Automaton(globs).match(data, offsets)


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    letters = "ab/.é"
    globs = ["", "*", "**", "?", "*.org/**", "a?c", "**b*", "??", "*a*b*/?", "é?*"]
    globs += ["".join(rng.choice(["a", "b", "/", ".", "é", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts = ["", "/", "日", "a日c", "x.org/", ".org"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    got = holds(globs, texts)
    for k, g in enumerate(globs):
        r = regex(g)
        assert got[:, k].tolist() == [bool(r.match(t)) for t in texts], g


def test_rules_in_blocks_and_words():
    rng = random.Random(8)
    rules = [urls.Rule(n, f"*.{n}**", "block") for n in {"".join(rng.choice("ab.") for _ in range(rng.randrange(1, 12))) for _ in range(400)}]
    texts = ["." + "".join(rng.choice("ab./") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    data, offsets = words.text_bytes(pa.array(texts))
    one, many = urls.Filter(rules, 1 << 16), urls.Filter(rules, 200)
    assert len(one.parts) == 1 and len(many.parts) > 5 and one.parts[0][1].words > 10
    want = []
    for t in texts:
        fit = [k for k, r in enumerate(one.rules) if regex(r.glob).match(t)]
        want.append(fit[0] if fit else -1)
    assert one.decide(data, offsets).tolist() == want == many.decide(data, offsets).tolist()


def plain(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    bad = "adult" in host or "spam" in host or not host or re.search(r"^/.*\.(exe|jpg|pdf|png|zip)\Z", path, re.S)
    return host, path, None, "block" if bad else "allow"


URLS = [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "https://Example.ORG/es/1?x=1", "http://a.example.org/es", "http://notorg/",
        "http://a.example.org/en/12#y", "http://example.org/en/2", "x://b.com/fr/", "x://B.COM/fr", "http://b.com/de/x?/fr/", "http://com/de/",
        "http://evil.net/x.org/", "http://evil.net/.org/a", "http://org:80/", "http://u@org/a", "http://example.org?/es/", "http://example.org#/es/",
        "a://b://c.org/", "http://spam-x.net/", "http://x.net/spam", "http://adult.net", "http://x.net/a/b.zip", "http://x.net/a.zip/b", "http://x.net/a.ZIP",
        "http://É.com/fr/é", "http://x.net/\n.pdf", "http://x.org\n/a", "http://x.net/" + "a/" * 20000 + "z.png", "http://.org/", "http://aorg/a"]


def test_pages_of_all_kinds(spark, tmp_path):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(7, URLS[7]), (None, URLS[7])]
    df = spark.createDataFrame([(k, u, "x", 5, "r") for k, u in rows], "page_id long, url string, host string, verdict int, _url string")
    out = urls.judged(df, _SITES, _GLOBS)
    assert out.columns == ["page_id", "url", "_url", "host", "path", "rule", "verdict"]
    want = sorted(((k, u, "r", *plain(u)) for k, u in rows), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op13_url_filter"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *plain(u)) for k, u in rows), key=str)


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://x.net/"), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judged(df, ()).collect()) == [(1, None, "allow"), (2, None, "block")]
    assert urls.judged(df.limit(0), _SITES).collect() == []
    tie = (urls.Rule("x.net/", "*.x.net/**", "block"), urls.Rule("y.net/", "**", "allow"))
    assert [r.rule for r in urls.judged(df, tie).filter("page_id = 1").collect()] == ["x.net/"]


def test_states_of_long_patterns_cross_words():
    text = "a" * 200 + "b"
    assert holds(["a" * 200 + "b", "a" * 199 + "b", "*" + "a" * 150 + "?", "a*b"], [text, "a" * 199 + "b"]).tolist() == [
        [True, False, True, True], [False, True, True, True]]
    assert np.array_equal(holds(["x"], []), np.zeros((0, 1), dtype=bool))

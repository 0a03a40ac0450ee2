"""One query per operator, over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    decontamination, language_model, languages, lexical, licenses, merkle, minhash, mixing, repeats, sharding, spotsigs, toxicity, urls,
)
from shelfwise.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

# Lower-cases A-Z only; what counts as a word inside text that is cut at punctuation.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(sql=f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') || '|' || len(ws)
         ELSE array_to_string(ws[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_id", "comp")


@query(sql=f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[s:s + k - 1], ' ') AS gram
      FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM i)),
e AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS gram
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s
            FROM d JOIN (SELECT DISTINCT k FROM i) ON len(ws) >= k)),
m AS (SELECT doc_id, item_id, k, s FROM e JOIN g USING (k, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated_words(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["after"] - r["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", sharding.document_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_id"))
    dealt = sharding.contiguous_shards(rows, 40, F.col("size"), [F.col("doc_id").asc_nulls_first(), F.col("text_id")])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query(sql="""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source
), c AS (
  SELECT *, sum(3 * source_size) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS weights
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)
), k AS (SELECT *, caps * w + 3 * source_size * (weights - ws) <= total * w AS stops FROM c),
l AS (SELECT (max(total) - coalesce(sum(3 * source_size) FILTER (stops), 0))::DOUBLE
        / nullif((max(weights) - coalesce(sum(w) FILTER (stops), 0))::DOUBLE, 0) AS lv FROM k),
t AS (SELECT source, source_size,
        CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE least((3 * source_size)::DOUBLE, coalesce(lv, 0.0) * w) END AS target
      FROM k, l),
r AS (SELECT d.*, source_size, target, coalesce(target / nullif(source_size::DOUBLE, 0), 0.0) AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["phrase"])
    names = lambda xs: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["similarity"])), F.lit(0.0)).alias("score"))


@query()
def op5_spotsigs_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _fold(parts: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = languages.fit(docs, _fold(3) != 1, judge=False, whole=False)
    predicted = languages.predict(docs.select("doc_id", (_fold(3) == 1).alias("held_out"), "text"), network)
    return predicted.drop("text")


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), _fold(5) != 0)
    scored = toxicity.score(docs.select("doc_id", (_fold(5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("spans").cast("long").alias("n_spans"))


@query()
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (_fold(7) == 2).alias("held_out"), "text")
    return language_model.score_documents(docs, ~F.col("held_out"))


@query()
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


@query(sql=f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ts FROM documents),
f AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM f),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM f) GROUP BY ALL),
i AS (SELECT item_id, t, count(*)::BIGINT AS times
      FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM p, s WHERE t IN (SELECT t FROM i) GROUP BY t, docs),
x AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM i JOIN w USING (t) JOIN p USING (t) JOIN f USING (r), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= 10""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_MANIFEST = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(n_chars: str) -> str:
    of = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    return f"sha256({' || '.join(of(n_chars if c == 'n_chars' else c) for c in _MANIFEST)})"


# CRC-32 of the decimal id, bit by bit: a byte is XORed in, then eight times a bit is shifted out.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
  lambda k: [ascii((doc_id::VARCHAR)[k])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


@query(sql=f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS given,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c,
    row_number() OVER () AS r
  FROM documents
), lv(level, g, i, c, h) AS (
  SELECT 0, g, i, c, leaf FROM d UNION ALL
  SELECT level + 1, g, i // 2, (c + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE c > 1 GROUP BY level, g, i // 2, c
), sub AS (SELECT g, h AS subroot FROM lv WHERE c = 1),
tv(level, i, c, h) AS (
  SELECT 0, g, count(*) OVER (), subroot FROM sub UNION ALL
  SELECT level + 1, i // 2, (c + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE c > 1 GROUP BY level, i // 2, c
), steps AS (
  SELECT r, n.level AS step, n.i % 2 AS odd, s.h FROM d JOIN lv n ON n.g = d.g AND n.i = d.i >> n.level AND n.c > 1
  LEFT JOIN lv s ON s.g = n.g AND s.level = n.level AND s.i = xor(n.i, 1)
  UNION ALL
  SELECT r, 1000 + n.level, n.i % 2, s.h FROM d JOIN tv n ON n.i = d.g >> n.level AND n.c > 1
  LEFT JOIN tv s ON s.level = n.level AND s.i = xor(n.i, 1)
), path AS (
  SELECT r, string_agg(coalesce(h, ''), '' ORDER BY step) AS siblings,
    list(CASE WHEN h IS NULL THEN '' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY step) AS steps FROM steps GROUP BY r
), f AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM tv WHERE c = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(given, coalesce(steps, [])), lambda a, x:
      sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a WHEN x[1] = 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM d JOIN sub USING (g) LEFT JOIN path USING (r)
)
SELECT *, folded_root = root AS verified FROM f""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*_MANIFEST)
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in _MANIFEST]
    tampered = F.when(F.col("doc_id").isNotNull() & (_fold(7) == 0), merkle.leaf(*changed))
    made = merkle.build(docs.withColumn("tampered", tampered), F.col("lang"), F.col("doc_id"),
                        merkle.leaf(*map(F.col, _MANIFEST)), ["doc_id", "tampered"])
    root = F.lit(made.root).cast("string")
    out = made.leaves.select(
        "doc_id", merkle.hexed("leaf").alias("leaf"), merkle.hexed("subroot").alias("subroot"), root.alias("root"),
        F.sha2(merkle.proof(), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_SITES = (
    urls.site("org/", urls.ALLOW), urls.site("example.org/es/", urls.BLOCK), urls.site("example.org/en/1", urls.BLOCK),
    urls.site("com/fr/", urls.ALLOW), urls.site("com/de/", urls.BLOCK))
# Where no site rule holds: hosts named so, and files that are not text.
_GLOBS = tuple(urls.Rule(g, g, urls.BLOCK) for g in ("*adult**", "*spam**", "*/**.exe", "*/**.jpg", "*/**.pdf", "*/**.png", "*/**.zip"))


@query(sql="""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages
), s(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT r, arg_max(h || p, strlen(h || p)) AS rule, arg_max(v, strlen(h || p)) AS v
      FROM u JOIN s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v
  WHEN contains(host, 'adult') OR contains(host, 'spam') OR host = '' THEN 'block'
  WHEN regexp_matches(path, '(?s)^/.*[.](exe|jpg|pdf|png|zip)$') THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN m USING (r)""")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), _SITES, _GLOBS).drop("url")

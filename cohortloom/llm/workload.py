"""Named queries over the test tables and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .exact import exact_duplicates
from .language import identify
from .lines import deduplicate_lines
from .merkle import verified_manifest
from .negatives import hard_negatives
from .ngram_join import ngram_jaccard_join
from .order_minhash import edit_fingerprints
from .phrases import repeated_passages
from .pieces import encode_pieces
from .quality import score_quality
from .toxicity import score_toxicity
from .urls import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [hash(ws)]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4]))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
walk(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT walk.doc_id, link.b FROM walk JOIN link ON link.a = walk.reached),
least AS (SELECT doc_id, min(reached) AS component_id FROM walk GROUP BY 1),
deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM n JOIN least USING (doc_id) LEFT JOIN deg ON a = n.doc_id
""")
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, folder, "documents"))


@query(rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, unnest(list_transform(range(1, greatest(1, len(ws) - 12) + 1), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS p
  FROM bw WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
dp AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
occ AS (SELECT DISTINCT doc_id, i, dp.k, item_id FROM dp JOIN win ON win.p = dp.p AND win.k = dp.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT p, min(doc_id) AS first FROM p GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (p) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS t FROM w),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS kept FROM x ANTI JOIN g USING (doc_id, j) GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = repeated_passages(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_A}', '{_Z}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).drop("n_chunks")


@query(rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_A}', '{_Z}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
b AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS ruled
  FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
l AS (SELECT DISTINCT host AS listed FROM b WHERE ruled = 'block')
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed IS NOT NULL AS host_listed
FROM b LEFT JOIN l ON host = listed
""")
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(table(spark, folder, "pages"))


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))


@query()
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return encode_pieces(table(spark, folder, "documents"))


@query()
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


# CRC-32 bit by bit: each byte is mixed in, then eight steps of one bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query(f"""
WITH RECURSIVE d AS (SELECT *, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_A}', '{_Z}')")} ELSE {_leaf("text")} END AS forged FROM documents),
l AS (SELECT doc_id, lang, leaf, forged, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up(lang, level, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM l
  UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, pos // 8, n),
s AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM s
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
side AS (
  SELECT lang, level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM up WINDOW w AS (PARTITION BY lang, level, pos // 8 ORDER BY pos)),
rim AS (
  SELECT level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM top WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)),
walk(lang, own, level, pos, n, acc, proof) AS (
  SELECT lang, pos, 0, pos, n, forged, '' FROM l
  UNION ALL SELECT w.lang, w.own, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(a || w.acc || b), w.proof || a || b
  FROM walk w JOIN side ON side.lang IS NOT DISTINCT FROM w.lang AND side.level = w.level AND side.pos = w.pos WHERE w.n > 1),
rise(lang, own, level, pos, n, acc, proof) AS (
  SELECT w.lang, w.own, 0, s.pos, s.n, w.acc, w.proof FROM walk w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL SELECT w.lang, w.own, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(a || w.acc || b), w.proof || a || b
  FROM rise w JOIN rim ON rim.level = w.level AND rim.pos = w.pos WHERE w.n > 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, top.digest AS root, sha256(rise.proof) AS proof_sha256, rise.acc AS folded_root, rise.acc = top.digest AS verified
FROM l JOIN rise ON rise.lang IS NOT DISTINCT FROM l.lang AND rise.own = l.pos AND rise.n = 1 JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top ON top.n = 1
""")
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return verified_manifest(table(spark, folder, "documents"))


@query("""
WITH v AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM m WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN m USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


@query()
def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_fingerprints(table(spark, folder, "documents"))

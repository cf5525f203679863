"""One query for each operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.collocations import collocations
from tidewell.llm.common import load
from tidewell.llm.fingerprint import fingerprints
from tidewell.llm.hard_negatives import hard_negatives
from tidewell.llm.language_id import identify
from tidewell.llm.mixing import mix
from tidewell.llm.near_dedup import near_duplicates
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality_model import resample
from tidewell.llm.quality_rules import quality_report
from tidewell.llm.secret_scan import secret_report
from tidewell.llm.sharding import LIMIT, MAX_BITS, assign_shards
from tidewell.llm.url_filter import judge
from tidewell.llm.web_archive import archive_report


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(load(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(load(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(load(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(load(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "pages"), load(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(load(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_warc_archive, op3_best_fit_packing, op4_near_dedup, op5_mixing,
        op6_sharding, op7_quality_rules, op8_quality_model, op9_fingerprints, op10_language_id,
        op11_hard_negatives, op12_collocations, op13_url_filter,
    )
}

ORACLE_SQL = {
    "op1_secret_scan": """
WITH rules(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18), ('hex', 2, '[0-9a-f]+', 0, 16),
  ('jwt', 3, 'eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}', 0, 1),
  ('pem', 4, '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----', 0, 1), ('forge', 5, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, doc_id, t, kind, rank, least, regexp_extract_all(t, pattern) AS hits, regexp_extract_all(t, pattern, grp) AS vals,
        string_split_regex(t, pattern) AS gaps FROM d, rules WHERE regexp_matches(t, pattern)),
s AS (SELECT r, kind, rank, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(vals[i]) AS val, least
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
p AS (SELECT r, kind, rank, val, least, hit,
        sum(gap) OVER w + coalesce(sum(hit) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
      FROM s WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
f AS (SELECT r, count(*) FILTER (kind = 'assign') AS n1, count(*) FILTER (kind = 'access') AS n2, count(*) FILTER (kind = 'hex') AS n3,
        string_agg(kind || ':' || a::BIGINT || ':' || (a + hit)::BIGINT, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || a::BIGINT || ':' || (a + hit)::BIGINT, ',' ORDER BY a, rank) AS spans
      FROM p WHERE val >= least GROUP BY r)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)""",
    "op2_warc_archive": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM k),
v AS (SELECT *, [('0x' || h[10 * g + 1 : 10 * g + 10])::BIGINT FOR g IN range(4)] AS parts FROM f)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[(i // 8 + 1)::INT] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)),
                   lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM v""",
    "op6_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes, ('0x' || md5(doc_id::VARCHAR)[1:{MAX_BITS // 4}])::BIGINT AS h FROM documents),
s AS (SELECT depth, (h >> ({MAX_BITS} - depth)) AS prefix, sum(bytes) <= {LIMIT} OR count(DISTINCT h) = 1 OR depth = {MAX_BITS} AS fits
      FROM d, (SELECT unnest(range({MAX_BITS + 1})) AS depth) GROUP BY 1, 2),
leaf AS (SELECT s.depth, s.prefix FROM s LEFT JOIN s AS u ON u.depth = s.depth - 1 AND u.prefix = (s.prefix >> 1)
         WHERE s.fits AND (s.depth = 0 OR NOT u.fits))
SELECT doc_id, bytes, depth::INT AS depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard
FROM d JOIN leaf ON leaf.prefix = (d.h >> ({MAX_BITS} - leaf.depth))""",
    "op7_quality_rules": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
x AS (SELECT r, i, w[i : i + 4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM x) WHERE c > 1),
z AS (SELECT r, count(DISTINCT i + k) AS n FROM y, (SELECT unnest(range(5)) AS k) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN z USING (r)),
f AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (n_symbols * 2 > n_words * 3)::INT
        + 8 * (n_dup_lines * 2 > n_lines AND n_lines >= 4)::INT + 16 * (word_chars > n_words * 40)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op12_collocations": """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
      FROM p, (VALUES (1), (2), (3)) AS t(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, any_value(a) AS a, min(struct_pack(score := (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f), k := k, l := x.f, r := y.f)) AS cut
      FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f AS y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1 :], ' ')
      GROUP BY k.lang, k.phrase),
o AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
r AS (SELECT lang, phrase, a, cut.l AS l, cut.r AS r, cut.score::BIGINT AS score FROM s LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_url_filter": """
WITH rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
m AS (SELECT i, max(struct_pack(labels := len(string_split(rule_host, '.')), n := length(rule_path), rule := rule_host || rule_path, verdict := verdict)) AS best
      FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (i)""",
}

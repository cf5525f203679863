"""App releases out of events: rows put together from phrases by row number, folded as a package and as a client do, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.labels import LOW_SQL, NOTES, SHOWN_SQL, listed, picked, picked_sql
from tidewell.catalog.registry import query, table
from tidewell.plans import releases
from tidewell.sources.shared import dealt

KEY = "event_id"
#: field -> (phrases, step)
FIELDS = {
    "broker_code": (["", "", "GTJA", " ｇｔｊａ", "", "citic 1", ""], 3), "broker_name": (["国泰 君安", "海通证券", "某券商", "Ａ券商", "国泰海通证券", "", "安信证券"], 5), "app_name": (["君弘", " 君弘", "ＡＰＰ 一", "app  一", "- 易淘金", ""], 7),
    "source_url": (["https://a.b/x", "http://u:p@a.b/", "", "https://localhost/x", "http://c.d/app/1", "ftp://a.b", "HTTPS://E.f", "http://g.h?x", "http://g.h/-/app/2"], 11), "content_sha256": (["", "AB12", "", "ab12", ""], 13),
    "crawl_time": (["2024-01-01T00:00:00", "2024-02-01T00:00:00", ""], 1), "app_version": (["", "v1.2", "版本号：V1.2", "１．２", "1. 2", "", "2.0", "版本 2.0", "V 3", "", "x"], 17),
    "platform": (["苹果", "ipad", "h5", "ＩＯＳ", "安 卓", "Android手机", "", "未知", "电视", "HarmonyOS"], 19), "publish_date": (["2024-01-05", "2024/1/9", "20240107", "", "2024.02.03", "soon", "2024年3月1日"], 23),
    "update_type": (["新功能", "问题修复", "", "其他", "甲类", "体验优化"], 29), "update_summary": (NOTES, 31), "processed_at": (["p1", "p2"], 1),
}
HIGHLIGHTS, TAGS = ((NOTES, 37), ([*NOTES[:12], "新增，行情推送！", "新增行情推送", "优化 登录体验。"], 41), (["", "Fix crash, and improve speed", "修复已知问题。"], 43)), ((["行情", "交易 ", ""], 47), (["-AI", "安全"], 53))


def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dealt(table(spark, sf_dir, "events").select(KEY), KEY)
    lists = {name: F.array(*[picked(KEY, phrases, step) for phrases, step in parts]).alias(name) for name, parts in (("highlights", HIGHLIGHTS), ("feature_tags", TAGS))}
    # seven events in eight have one of 40 groups' fields, so that releases have many rows
    events = events.select(F.when(F.col(KEY) % 8 > 0, F.col(KEY) % 997).otherwise(F.col(KEY)).alias(KEY))
    return events.select(*[picked(KEY, phrases, step).alias(name) for name, (phrases, step) in FIELDS.items()], *lists.values())


WIDE, PLAIN = "ＡＰＩＯＳｇｔｊａ１２．：（）", "APIOSgtja12.:()"


def nfkc_sql(x: str) -> str:
    """Compatibility form of the phrases above."""
    return f"trim(translate({x}, '{WIDE}', '{PLAIN}'))"


def canonical_sql(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '^(?:[-*•]\\s*)+', ''))"


def score_sql(x: str) -> str:
    hits = f"len(list_filter({listed(releases.CHANGE_WORDS)}, lambda w: contains(lower({x}), w)))"
    low = f"length({x}) < 2 OR {hits} = 0 OR " + " OR ".join(f"regexp_matches({x}, '{p}')" for p in LOW_SQL)
    verb = f"CASE WHEN regexp_matches({x}, '(?i)(修复|解决|新增|上线|支持|优化|升级|适配|改进|enhanc|fix|add|support|improv)') THEN 8 ELSE 0 END"
    return f"(CASE WHEN {low} THEN -100 ELSE least(length({x}), 180) // 10 + 10 * {hits} + {verb} END)"


def names_sql(x: str, names: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


_ROWS_SQL = f"""
i AS (SELECT row_number() OVER () AS i, CASE WHEN {KEY} % 8 > 0 THEN {KEY} % 997 ELSE {KEY} END AS {KEY} FROM events),
r AS (SELECT i, {", ".join(f"{picked_sql(KEY, p, s)} AS {n}" for n, (p, s) in FIELDS.items())},
        list_filter(list_transform([{", ".join(picked_sql(KEY, p, s) for p, s in HIGHLIGHTS)}], lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS highlights,
        list_filter(list_transform([{", ".join(picked_sql(KEY, p, s) for p, s in TAGS)}], lambda x: trim(x)), lambda x: x <> '') AS feature_tags FROM i),
n AS (SELECT i, trim(broker_code) AS broker_code, lower(regexp_replace({nfkc_sql("broker_code")}, '\\s+', '', 'g')) AS code, regexp_replace(broker_name, '\\s+', '', 'g') AS bare_broker,
        {canonical_sql("app_name")} AS app_name, lower(trim(regexp_replace({nfkc_sql(canonical_sql("app_name"))}, '\\s+', ' ', 'g'))) AS app,
        CASE WHEN regexp_matches(source_url, '^(?i:https?)://[^/?#@]+(?:[/?#]|$)') AND NOT regexp_matches(source_url, '://localhost|[^A-Za-z0-9]/app/') THEN source_url ELSE '' END AS source_url, content_sha256 AS sha, crawl_time, processed_at,
        {canonical_sql("app_version")} AS app_version, {nfkc_sql("platform")} AS platform,
        lower(regexp_replace(regexp_replace(regexp_replace({nfkc_sql("app_version")}, '^版本(?:号)?\\s*[:：]?\\s*', ''), '^[vV]\\s*', ''), '\\s+', '', 'g')) AS version,
        coalesce(strftime(coalesce(try_strptime(publish_date, '%Y%m%d'), try_strptime(replace(translate(publish_date, '/.年月', '----'), '日', ''), '%Y-%m-%d')), '%Y-%m-%d'), '') AS publish_date,
        {canonical_sql("update_type")} AS kind, {canonical_sql("update_summary")} AS summary, list_transform(highlights, lambda x: {canonical_sql("x")}) AS highlights, list_transform(feature_tags, lambda x: {canonical_sql("x")}) AS tags FROM r),
b AS (SELECT * REPLACE (coalesce({names_sql("lower(regexp_replace(platform, '\\s+', '', 'g'))", releases.PLATFORMS)}, nullif(platform, ''), '未知') AS platform),
        coalesce({names_sql("bare_broker", releases.BROKERS)}, bare_broker) AS broker_name FROM n WHERE bare_broker <> '' OR broker_code <> '' OR app_name <> '' OR summary <> ''),
k AS (SELECT *, CASE WHEN code <> '' THEN 'code:' || code ELSE 'broker:' || lower(broker_name) END AS broker FROM b),
g AS (SELECT *, CASE WHEN version <> '' THEN concat_ws('|', 'versioned', broker, app, version) ELSE concat_ws('|', 'unversioned', broker, app, lower(platform), publish_date, source_url,
        CASE WHEN sha <> '' THEN 'hash:' || lower(sha) ELSE 'digest:' || sha256(to_json(struct_pack(app_version := version, feature_tags := list_sort(tags), highlights := list_sort(highlights), source_url := source_url,
          update_summary := summary, update_type := kind))::VARCHAR) END) END AS key, {score_sql("summary")} AS s, coalesce(list_max(list_transform(highlights, lambda x: {score_sql("x")})), -100) AS h FROM k),
t AS (SELECT key, min((-n, t)) AS note FROM (SELECT key, t, {score_sql("t")} AS n FROM (SELECT key, unnest(highlights) AS t FROM g)) WHERE n > -100 GROUP BY key, lower(regexp_replace(t, '[\\s，。；;、,:：.!！?？]+', '', 'g'))),
l AS (SELECT key, list(note[2] ORDER BY note) AS notes FROM t GROUP BY key),
a AS (SELECT key, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT key, unnest(tags) AS tag FROM g) WHERE tag <> '' GROUP BY key),
f AS (SELECT key, arg_max(struct_pack(broker_code, broker_name, app_name, source_url, sha, crawl_time, app_version, processed_at), (s, h, publish_date, sha, source_url)) AS r, min(nullif(version, '')) AS v,
        max((publish_date, crawl_time, processed_at)) FILTER (publish_date <> '') AS d, min(nullif(sha, '')) AS sha, min(nullif(source_url, '')) AS url,
        min((coalesce(nullif(list_position({listed(releases.UPDATE_TYPES)}, coalesce(nullif(kind, ''), '其他')), 0), 6), coalesce(nullif(kind, ''), '其他'))) FILTER (s >= 0 OR h >= 0) AS kind,
        min((-s, summary)) FILTER (s > -100) AS said, min(nullif(platform, '未知')) AS p1, max(nullif(platform, '未知')) AS p2, count(*) AS n_merged FROM g GROUP BY key),
o AS (SELECT key, coalesce(r.broker_code, '') AS broker_code, coalesce(nullif(r.broker_name, ''), r.broker_code) AS broker_name, r.app_name AS app_name, coalesce(v, r.app_version) AS app_version, coalesce(nullif(r.source_url, ''), url, '') AS source_url,
        coalesce(nullif(r.sha, ''), f.sha, '') AS content_sha256, coalesce(d[2], r.crawl_time) AS crawl_time, coalesce(d[1], '') AS publish_date, coalesce(d[3], r.processed_at) AS processed_at, coalesce(kind[2], '其他') AS update_type,
        coalesce(said[2], notes[1], '') AS update_summary, CASE WHEN p1 <> p2 THEN '全平台' ELSE coalesce(p1, '未知') END AS platform, coalesce(notes, []) AS notes, coalesce(tags, []) AS tags, n_merged
      FROM f LEFT JOIN l USING (key) LEFT JOIN a USING (key)),
z AS (SELECT *, 'app-' || sha256(key) AS id, list_filter(notes, lambda x: x <> update_summary)[1:5] AS highlights FROM o)"""


@query(f"""
WITH {_ROWS_SQL}
SELECT id, broker_code, broker_name, app_name, app_version, source_url, content_sha256, crawl_time, publish_date, processed_at, update_type, update_summary, platform, array_to_string(highlights, '|') AS highlights, array_to_string(tags, '|') AS feature_tags,
       lower(concat_ws(chr(10), broker_name, broker_code, app_name, app_version, update_summary, update_type, array_to_string(tags, ' '), array_to_string(highlights, ' '))) AS search_text, n_merged FROM z""")
def release_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of releases of apps, folded into one record a release."""
    out = releases.folded(release_rows(spark, sf_dir)).drop("release_key")
    return out.withColumns({c: F.array_join(c, "|") for c in ("highlights", "feature_tags")})


@query(f"""
WITH {_ROWS_SQL},
c AS (SELECT *, lower(regexp_replace(regexp_replace(trim(app_version), '^[vV]\\s*', ''), '\\s+', '', 'g')) AS cv FROM z),
w AS (SELECT *, CASE WHEN cv = '' THEN 'unversioned:' || id ELSE 'versioned:' || lower(trim(coalesce(nullif(broker_code, ''), broker_name))) || '||' || lower(regexp_replace(trim(app_name), '\\s+', ' ', 'g')) || '||' || cv END AS own,
        trim(regexp_replace(update_summary, '\\s+', ' ', 'g')) AS flat FROM c),
y AS (SELECT own, id, unnest(highlights) AS t FROM w),
q AS (SELECT own, id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS x FROM y UNION ALL SELECT own, id, flat FROM w),
e AS (SELECT DISTINCT x, CASE WHEN x = '' OR {" OR ".join(f"regexp_matches(x, '{p}')" for p in SHOWN_SQL)} THEN -100 ELSE least(length(x), 120) / 30
        + CASE WHEN regexp_matches(x, '(?i)新增|增加|上线|推出|支持|优化|提升|改进|升级|修复|解决|调整|完善|改版|安全|合规|风控') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(x, '[0-9]') THEN 1 ELSE 0 END END AS n FROM q),
u AS (SELECT w.*, e.n AS s, greatest(0, coalesce((SELECT max(e2.n) FROM y JOIN e AS e2 ON e2.x = trim(regexp_replace(y.t, '\\s+', ' ', 'g')) WHERE y.id = w.id), 0)) AS h FROM w JOIN e ON e.x = w.flat),
v AS (SELECT own, arg_min(struct_pack(broker_code, app_version, update_type, platform), (-s, -h, -coalesce(epoch_ms(try_strptime(publish_date, '%Y-%m-%d')), 0), id)) AS r, max(publish_date) AS publish_date, sum(n_merged)::BIGINT AS n_merged,
        arg_min(update_summary, (-s, id)) FILTER (s > -100) AS said, min(nullif(platform, '未知')) AS p1, max(nullif(platform, '未知')) AS p2 FROM u GROUP BY own),
s AS (SELECT own, list(x ORDER BY n DESC, x)[1:5] AS told FROM (SELECT DISTINCT y.own, e.x, e.n FROM y JOIN e ON e.x = trim(regexp_replace(y.t, '\\s+', ' ', 'g')) JOIN v ON v.own = y.own WHERE e.n > -100 AND (said IS NULL OR e.x <> said)) GROUP BY own),
g2 AS (SELECT own, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT own, unnest(tags) AS tag FROM w) GROUP BY own)
SELECT v.own AS id, r.broker_code AS broker_code, r.app_version AS app_version, r.update_type AS update_type, CASE WHEN p1 <> p2 THEN '全平台' ELSE coalesce(p1, nullif(r.platform, ''), '未知') END AS platform, publish_date,
       coalesce(said, '') AS update_summary, coalesce(array_to_string(told, '|'), '') AS highlights, coalesce(array_to_string(tags, '|'), '') AS feature_tags, n_merged
FROM v LEFT JOIN s ON s.own = v.own LEFT JOIN g2 ON g2.own = v.own""")
def shown_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package's records as a client shows them, one row a broker, app and version."""
    out = releases.shown_folded(releases.folded(release_rows(spark, sf_dir))).drop("broker_name", "app_name")
    return out.withColumns({c: F.array_join(c, "|") for c in ("highlights", "feature_tags")})

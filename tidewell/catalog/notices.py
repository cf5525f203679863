"""Stage, domain, tags and score of notices, and what release notes tell, on texts put together from the rules' own words by row number.

The SQL tests each table of keywords by itself, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.labels import NOTES, listed, picked, picked_sql
from tidewell.catalog.registry import query, table
from tidewell.functions import text, values
from tidewell.plans import notices, releases
from tidewell.sources.shared import dealt

#: Neutral phrases, then the words of all tables: titles hold one or two of them.
NEUTRAL = ["", "某项目", "2024年度", "采购", "关于", "公司", "第一批", "（总部）", "x", "bi"]
WORDS = NEUTRAL * 12 + sorted(
    {w for words in [*notices.DOMAINS.values(), *notices.BUSINESS_DOMAINS.values(), *notices.TAGS.values(), notices.CAPITAL_MARKET, notices.SYSTEMS, notices.OBJECTS, notices.SERVICES, notices.OTHER_CONTEXT, notices.SOFT_CONTEXT, notices.OTHER_WORDS] for w in words}
)
CATEGORIES = ["IT软硬件", " IT软硬件", "工程建设与装修", "", "服务"]
STAGED = ["结果公告", "流标公告", "招标公告", "中标候选人公示", "询价", "更正", "", "终止公告", "成交"]
KEY = "o_orderkey"


def _joined(parts: list[int]) -> Column:
    return F.concat(*[picked(KEY, WORDS, step) for step in parts])


def _joined_sql(parts: list[int]) -> str:
    return " || ".join(f"words[({KEY} * {step}) % {len(WORDS)} + 1]" for step in parts)


def held_sql(column: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter({listed(words)}, lambda w: contains({column}, w))) > 0"


def first_sql(column: str, tables: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {held_sql(column, words)} THEN '{name}'" for name, words in tables.items()) + " END"


FIELDS = {"title": [7, 31], "scope": [1009], "subcategory": [57]}
DOMAIN_SQL = f"""
w AS (SELECT {listed(WORDS)} AS words),
t AS (SELECT {KEY}, {", ".join(f"{_joined_sql(v)} AS {k}" for k, v in FIELDS.items())}, {picked_sql(KEY, CATEGORIES, 3)} AS category,
        CASE {KEY} % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_broker FROM orders, w),
c AS (SELECT *, title || ' ' || scope AS context, title || ' ' || scope || ' ' || subcategory || ' ' || category AS whole FROM t),
m AS (SELECT *, {first_sql("context", notices.BUSINESS_DOMAINS)} AS business, {first_sql("context", notices.DOMAINS)} AS near, {first_sql("whole", notices.DOMAINS)} AS wide,
        {held_sql("context", notices.SYSTEMS + notices.OBJECTS + notices.SERVICES)} AS thing, {held_sql("title", notices.SYSTEMS + notices.OBJECTS + notices.SERVICES)} AS own,
        {held_sql("context", notices.OTHER_CONTEXT)} AS hard, {held_sql("context", notices.SOFT_CONTEXT)} AS soft, {held_sql("context", notices.SYSTEMS)} AS near_system,
        {held_sql("context", notices.CAPITAL_MARKET)} AS near_capital, {held_sql("whole", notices.SYSTEMS)} AS system, {held_sql("whole", notices.CAPITAL_MARKET)} AS capital, {held_sql("whole", notices.OTHER_WORDS)} AS other FROM c),
s AS (SELECT *, CASE WHEN business IS NOT NULL AND thing AND NOT hard THEN 'business' WHEN coalesce(is_broker, FALSE) AND own AND NOT hard AND (NOT soft OR business IS NOT NULL) THEN 'broker'
        WHEN hard OR soft AND (business IS NULL OR NOT thing) THEN 'excluded' WHEN near IS NOT NULL AND near_system THEN 'named' WHEN near_capital AND near_system THEN 'named capital'
        WHEN other THEN 'other' WHEN wide IS NOT NULL THEN 'domain' WHEN capital AND system THEN 'capital' WHEN trim(category) = 'IT软硬件' THEN 'category' ELSE 'none' END AS step FROM m),
d AS (SELECT *, step NOT IN ('excluded', 'other', 'none') AS is_fintech, CASE step WHEN 'business' THEN business WHEN 'broker' THEN coalesce(business, near, 'IT运维与技术服务') WHEN 'named' THEN near
        WHEN 'named capital' THEN '投行与资本市场' WHEN 'domain' THEN wide WHEN 'capital' THEN '投行与资本市场' WHEN 'category' THEN 'IT运维与技术服务' ELSE '非金融科技及其他' END AS domain,
        array_to_string(list_filter([{", ".join(f"CASE WHEN {held_sql('title || subcategory', v)} THEN '{k}' END" for k, v in notices.TAGS.items())}], lambda x: x IS NOT NULL), ',') AS tags FROM s)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {k: _joined(v).alias(k) for k, v in FIELDS.items()}
    broker = F.when(F.col(KEY) % 3 == 0, True).when(F.col(KEY) % 3 == 1, False).alias("is_broker")
    rows = table(spark, sf_dir, "orders").select(KEY, "o_orderdate", "o_totalprice", *fields.values(), picked(KEY, CATEGORIES, 3).alias("category"), broker, picked(KEY, STAGED, 5).alias("announced"))
    return notices.domains(rows, "title", "scope", "subcategory", "category", "is_broker")


@query(f"WITH {DOMAIN_SQL} SELECT {KEY}, step, domain, is_fintech, tags FROM d")
def notice_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and tags of notices, with the decision that fell."""
    return _classified(spark, sf_dir).select(KEY, "step", "domain", "is_fintech", F.array_join("tags", ",").alias("tags"))


@query(f"""
WITH {DOMAIN_SQL},
o AS (SELECT {KEY}, o_orderdate, o_totalprice, {picked_sql(KEY, STAGED, 5)} AS announced FROM orders),
g AS (SELECT d.{KEY}, domain, tags, announced, o_orderdate, CASE WHEN regexp_matches(announced, '流标|废标') THEN '流标废标' WHEN regexp_matches(announced, '结果|中标|成交|候选人公示') THEN '结果公示'
        WHEN regexp_matches(announced, '采购|招标|询价|供应商招募|单一来源|竞争性谈判') THEN '采购招标' ELSE '其他' END AS stage,
        CASE WHEN regexp_matches(announced, '结果|中标|成交|中选|流标|废标|终止|取消') THEN 'result' ELSE 'procurement' END AS notice_type,
        d.{KEY} % 4 = 1 AS supplied, CASE WHEN o_totalprice > 200000 THEN 'winning' WHEN o_totalprice > 100000 THEN 'budget' ELSE '' END AS kind FROM d JOIN o USING ({KEY})),
l AS (SELECT *, epoch_ms(max(o_orderdate::TIMESTAMP) OVER ()) - epoch_ms(o_orderdate::TIMESTAMP) <= 2592000000 AS recent FROM g)
SELECT {KEY}, stage, notice_type, ((domain = 'AI与智能化')::INT * 30 + (domain = '交易、柜台与核心系统')::INT * 20 + contains(tags, '信创')::INT * 15 + (stage = '结果公示')::INT * 15 + supplied::INT * 10
         + (kind = 'winning')::INT * 10 + (kind = 'budget')::INT * 5 + coalesce(recent, FALSE)::INT * 20)::INT AS score,
       CASE WHEN domain = 'AI与智能化' THEN '近期新增的AI与智能化项目' WHEN domain = '交易、柜台与核心系统' THEN '涉及核心交易系统建设' WHEN contains(tags, '信创') THEN '具有信创或国产化属性'
            WHEN stage = '结果公示' AND supplied THEN '结果公告已披露供应商' WHEN kind = 'winning' THEN '公告公开披露成交金额' WHEN kind = 'budget' THEN '公告公开披露项目预算' ELSE '公开招采动态值得关注' END AS reason FROM l""")
def notice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage, type, points and first reason of notices, the latest one being today."""
    price = F.col("o_totalprice")
    rows = _classified(spark, sf_dir).withColumns({
        "stage": notices.stage(F.col("announced")), "notice_type": notices.notice_type(F.col("announced")), "supplier": F.when(F.col(KEY) % 4 == 1, "s"),
        "amount_kind": F.when(price > 200000, "winning").when(price > 100000, "budget"), "published": F.col("o_orderdate").cast("timestamp"),
    })
    return notices.scored(rows).select(KEY, "stage", "notice_type", "score", "reason")


LINES = [*NOTES, "# 标题", "更新说明：", "版本：V2.1.0", "更新日期：2024/3/5", "支持 ios 与 Android 的新特性", "看点：https://a.b/c 新增专区；", "看点与复盘", "平台：HarmonyOS", "版本号 3.4", "发布时间 20240102", "更新时间：2024年1月2日", "- 智能选股上线", "解决开户卡顿"]
STEPS = (1, 7, 11, 3, 5)
NOTE_LINES_SQL = f"""
t AS (SELECT p_partkey, [{", ".join(picked_sql("p_partkey", LINES, k) for k in STEPS)}] AS lines FROM part),
f AS (SELECT p_partkey, array_to_string(lines, chr(10)) AS content FROM t),
u AS (SELECT p_partkey, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
x AS (SELECT p_partkey, i, regexp_replace(trim(regexp_replace(line, '^\\s*(?:[-*•·]\\s*|\\d+[.)、]\\s*)', ''), ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g') AS x FROM u),
m AS (SELECT *, lower(x) AS low, regexp_replace(x, '[^A-Za-z0-9\\x{{3400}}-\\x{{9fff}}]', '', 'g') AS meaning FROM x),
l AS (SELECT *, x = '' OR {held_sql("low", tuple(w.lower() for w in releases.SOURCE_LOW_VALUE))}
        OR regexp_matches(low, '^(?:运行环境|系统要求|需要|支持|兼容)?[^。；;]{{0,24}}(?:ios|android|harmonyos|安卓|苹果)[^。；;]{{0,24}}(?:版本|以上|以下|及更高|及以上|[0-9]+(?:\\.[0-9]+){{0,2}})')
        OR regexp_matches(low, 'https?://|www\\.|(?:^|[：:]|\\s)md5(?:$|[：:]|\\s)')
        OR regexp_matches(low, '[0-9a-f]{{24,}}') AND NOT regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_])\\d+(?:\\.\\d+){{1,3}}(?:$|[^\\p{{L}}\\p{{N}}_])')
        OR length(meaning) < 2 OR replace(meaning, left(meaning, 1), '') = '' OR (length(x) - length(meaning) > 2 * length(meaning) AND length(x) > 8) AS low_value FROM m),
k AS (SELECT *, NOT starts_with(x, '#') AND NOT low_value AND NOT list_contains({listed(releases.SOURCE_GENERIC)}, x) AND ({held_sql("x", releases.SOURCE_CHANGES)} OR
        length(x) <= 120 AND regexp_matches(x, '^(支持|现已支持|现在支持|正式支持)') AND NOT regexp_matches(x, '系统|语言|客户|版本')) AS tells,
        trim(regexp_replace(x, 'https?://\\S+|www\\.\\S+', '', 'g'), ' ，,;；') AS bare FROM l),
c AS (SELECT p_partkey, list(bare ORDER BY i) AS changes FROM (SELECT p_partkey, bare, min(i) AS i FROM k WHERE tells AND bare <> '' GROUP BY ALL) GROUP BY p_partkey),
h AS (SELECT f.p_partkey, content, coalesce(changes, []) AS changes FROM f LEFT JOIN c USING (p_partkey))"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [picked("p_partkey", LINES, k) for k in STEPS]
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.concat_ws("\n", *lines).alias("content"))


@query(f"""
WITH {NOTE_LINES_SQL},
j AS (SELECT p_partkey, changes, lower(array_to_string(changes, ' ')) AS said FROM h)
SELECT p_partkey, CASE WHEN regexp_matches(said, '修复|解决|已知问题|修正|纠正') THEN '问题修复' WHEN regexp_matches(said, '安全|合规|风控|加固|漏洞') THEN '合规安全'
         WHEN regexp_matches(said, '新增|增加|上线|支持|推出|发布') THEN '新功能' WHEN regexp_matches(said, '优化|提升|改进') THEN '体验优化' ELSE '其他' END AS update_type,
       coalesce(nullif(array_to_string(list_filter(['行情', '交易', '开户', '理财', '资讯'], lambda w: contains(said, w)) || CASE WHEN regexp_matches(said, 'ai|智能') THEN ['AI智能'] ELSE [] END
         || CASE WHEN contains(said, '安全') THEN ['安全'] ELSE [] END, ','), ''), '其他') AS feature_tags, array_to_string(changes, '|') AS highlights FROM j""")
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, tags and highlights of release notes by their lines of change, without a model."""
    told = _contents(spark, sf_dir).select("p_partkey", notices.update_fields(notices.meaningful_lines(F.col("content"))).alias("t"))
    return told.select("p_partkey", "t.update_type", F.array_join("t.feature_tags", ",").alias("feature_tags"), F.array_join("t.highlights", "|").alias("highlights"))


@query(f"""
WITH {NOTE_LINES_SQL},
v AS (SELECT *, list_distinct(regexp_extract_all(content, '(?i)(?:版本(?:号)?|version|V)\\s*[：:]?\\s*[vV]?([0-9]+(?:\\.[0-9]+){{1,3}})', 1)) AS found,
        regexp_extract_all(content, '(?i)(?:版本(?:号)?|version|V)\\s*[：:]?\\s*[vV]?([0-9]+(?:\\.[0-9]+){{1,3}})', 1) AS every,
        list_filter(['iOS', 'Android', 'HarmonyOS'], lambda w: contains(lower(content), lower(w))) AS systems,
        regexp_extract(content, '(?:更新(?:日期|时间)?|发布日期|发布时间)\\s*[：:]?\\s*(\\d{{4}}[-/.年]\\d{{1,2}}[-/.月]\\d{{1,2}}日?|\\d{{8}})', 1) AS dated FROM h),
e AS (SELECT *, array_to_string(list_filter(every, lambda w, i: list_position(every, w) = i), '、') AS version,
        CASE WHEN len(systems) > 1 THEN '全平台' ELSE coalesce(systems[1], '') END AS platform,
        coalesce(strftime(coalesce(try_strptime(replace(replace(dated, '/', '-'), '.', '-'), '%Y-%m-%d'), try_strptime(dated, '%Y%m%d')), '%Y-%m-%d'), '') AS published FROM v),
r AS (SELECT k.p_partkey, list('官方更新说明候选：' || x ORDER BY i) AS more FROM (SELECT p_partkey, x, min(i) AS i FROM k WHERE x <> '' AND NOT low_value AND NOT starts_with(x, '#')
        AND NOT list_contains({listed(releases.SOURCE_GENERIC)}, x) AND NOT list_contains(['更新说明', '新版特性', '更新内容'], rtrim(x, '：:')) AND NOT regexp_matches(x, '^(?:版本|平台|更新日期|日期证据|版本证据|平台证据)\\s*[：:]')
        GROUP BY ALL) AS k JOIN h ON h.p_partkey = k.p_partkey AND NOT list_contains(changes, x) GROUP BY k.p_partkey)
SELECT e.p_partkey, version, platform, published, array_to_string(list_filter([CASE WHEN version <> '' THEN '版本证据：' || version END, CASE WHEN platform <> '' THEN '平台证据：' || platform END,
         CASE WHEN published <> '' THEN '日期证据：' || published END], lambda w: w IS NOT NULL) || list_transform(changes, lambda w: left(w, 240)) || coalesce(more, []), chr(10)) AS prepared
FROM e LEFT JOIN r USING (p_partkey)""")
def note_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version, platform and date that a note names, and what a model is given of it."""
    # a generator's rows are computed once, whatever reads them
    rows = _contents(spark, sf_dir).select("p_partkey", F.inline(F.array(notices.prepared(F.col("content")))))
    return rows.select("p_partkey", "evidence.version", "evidence.platform", "evidence.published", "prepared")


PACKAGES = ["第一包", "二标段", "包件03", "第两包", "标段 12", "包十二", "三十一包", "2024包", "第〇包", "百包", "包件", "某项目", "十包件", "第零一标段", "000包", "", "包 九十"]
AMOUNTS = ["-5万", "约5.2（亿元）", "1,234.5元", "万", "null", "3 亿 2 万", "-0.5", "12.345678亿", "0", ""]
NUMERAL_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.NUMERALS.items())


@query(f"""
WITH t AS (SELECT p_partkey, {picked_sql('p_partkey', PACKAGES, 3)} AS package, {picked_sql('p_partkey', AMOUNTS, 7)} AS amount FROM part),
n AS (SELECT *, ltrim(coalesce(nullif(regexp_extract(package, '第?([0-9]{{1,3}}|[零〇一二两三四五六七八九十]{{1,3}})(?:包|标段)', 1), ''),
                               nullif(regexp_extract(package, '(?:包件|包|标段)\\s*([0-9]{{1,3}}|[零〇一二两三四五六七八九十]{{1,3}})', 1), '')), '0') AS said,
        nullif(regexp_extract(replace(amount, ',', ''), '-?[0-9]+(?:\\.[0-9]+)?'), '') AS number FROM t)
SELECT p_partkey, CASE WHEN said = '' THEN 0 WHEN regexp_matches(said, '^[0-9]+$') THEN try_cast(said AS INT) WHEN length(said) = 1 THEN CASE said {NUMERAL_SQL} END
         WHEN length(said) = 2 AND said[1] = '十' THEN 10 + CASE said[2] {NUMERAL_SQL} END WHEN length(said) = 2 AND said[2] = '十' THEN 10 * CASE said[1] {NUMERAL_SQL} END
         WHEN length(said) = 3 AND said[2] = '十' THEN 10 * CASE said[1] {NUMERAL_SQL} END + CASE said[3] {NUMERAL_SQL} END END AS package_number,
       (number::DECIMAL(28, 6) * CASE WHEN contains(amount, '亿') THEN 100000000 WHEN contains(amount, '万') THEN 10000 ELSE 1 END)::DECIMAL(20, 2)::VARCHAR AS amount FROM n""")
def package_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of packages in digits or Chinese, amounts with sign and unit."""
    rows = table(spark, sf_dir, "part").select("p_partkey", picked("p_partkey", PACKAGES, 3).alias("package"), picked("p_partkey", AMOUNTS, 7).alias("amount"))
    return rows.select("p_partkey", text.package_number(F.col("package")).alias("package_number"), values.amount_with_units(F.col("amount")).cast("string").alias("amount"))

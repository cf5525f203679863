"""Rules over Chinese notices and release notes, on texts put together from phrases by row number, each beside its SQL.

The SQL states the rules' words and patterns again, in DuckDB's dialect.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.flows import work_folder
from tidewell.catalog.registry import query, table
from tidewell.functions import text, values
from tidewell.operators import facets, keyed, links
from tidewell.plans import linkage, releases
from tidewell.sources import files, publish


def picked(key: str, phrases: list[str], step: int) -> Column:
    """The phrase of a row: its key times step, around the list."""
    return F.element_at(F.array(*[F.lit(x) for x in phrases]), (F.pmod(F.col(key) * step, F.lit(len(phrases))) + 1).cast("int"))


def picked_sql(key: str, phrases: list[str], step: int) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in phrases)
    return f"[{quoted}][({key} * {step}) % {len(phrases)} + 1]"


def listed(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


NAMES = ["某证券行情系统", "关于数据中心的", "有关办公家具（二期）", "  交易平台 升级-", "【风控】平台", "关于有关系统", "A_B 柜台系统", ""]
ENDS = ["采购公告", "（中标公告）", " 招标公告 取消公告", "竞争性磋商公告", "中标候选人公示", "更正公告", "-结果公告", "", "成交候选人公示】"]
NUMBERS = ["ab－01/2", "P.2024—007", "（x）:9", "q_1\\2", "", "Z 9-9"]
SUFFIX_SQL = "中标候选人公示|成交候选人公示|中标结果公告|成交结果公告|采购结果公告|结果公告|招标公告|采购公告|询价公告|竞争性磋商公告|竞争性谈判公告|磋商公告|谈判公告|比选公告|中标公告|成交公告|流标公告|废标公告|终止公告|取消公告"
SIGNS_SQL = "[\\s,，.。;；:：!！?？、/\\\\|·`''\"“”‘’\\[\\]【】{}<>《》\\-＿_+＝=~～]+"


@query(f"""
WITH t AS (SELECT p_partkey, trim({picked_sql('p_partkey', NAMES, 1)} || {picked_sql('p_partkey', ENDS, 3)}) AS name, {picked_sql('p_partkey', NUMBERS, 5)} AS number FROM part),
s AS (SELECT *, CASE WHEN regexp_matches(name, '({SUFFIX_SQL})$')
        THEN regexp_replace(regexp_replace(name, '([ \\-_（）()\\[\\]【】]*({SUFFIX_SQL}))+[ \\-_（）()\\[\\]【】]*$', ''), '^[ \\-_（）()\\[\\]【】]+|[ \\-_（）()\\[\\]【】]+$', '', 'g') ELSE name END AS bare FROM t)
SELECT p_partkey, bare, regexp_replace(regexp_replace(regexp_replace(translate(lower(bare), '（）', '()'), '^(关于|有关)', ''), '的$', ''), '{SIGNS_SQL}', '', 'g') AS key,
       regexp_replace(upper(translate(number, '－—–', '---')), '[\\s\\-_/\\\\.:：（）()\\[\\]【】]+', '', 'g') AS number_key FROM s""")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notice suffixes stripped again and again, keys of names and numbers."""
    name = F.trim(F.concat(picked("p_partkey", NAMES, 1), picked("p_partkey", ENDS, 3)))
    number = picked("p_partkey", NUMBERS, 5)
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_suffixes(name).alias("bare"), text.project_key(name).alias("key"), text.number_key(number).alias("number_key"))


FORMS = ["股份有限公司", "有限责任公司", "有限公司", "证券股份有限公司", "证券有限责任公司", "集团公司", "", "·上海分公司"]


@query(f"""
WITH n AS (SELECT DISTINCT n_name || {picked_sql('c_custkey', FORMS, 1)} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT name, regexp_replace(name, '{SIGNS_SQL}', '', 'g') AS whole,
        regexp_replace(regexp_replace(name, '{SIGNS_SQL}', '', 'g'), '(证券股份有限公司|证券有限责任公司|股份有限公司|有限责任公司|有限公司)$', '') AS short FROM n)
SELECT a.name AS name, b.name AS other, CASE WHEN a.whole = b.whole THEN 1.0 WHEN a.short = b.short THEN 0.9 ELSE 0.82 END::DOUBLE AS similarity FROM k a, k b
WHERE a.name < b.name AND (a.whole = b.whole OR a.short = b.short OR length(a.short) >= 4 AND starts_with(b.short, a.short) OR length(b.short) >= 4 AND starts_with(a.short, b.short))""")
def purchaser_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of company names that are alike, found by equal short names and prefixes."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    names = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    names = names.select(F.concat("n_name", picked("c_custkey", FORMS, 1)).alias("name")).distinct().withColumn("short", text.company_short(F.col("name")))
    near = linkage.near_buyers(names.select(F.col("short").alias("r_key_buyer")), names.select(F.col("short").alias("n_key_buyer")))
    pairs = near.join(names.select("name", F.col("short").alias("r_key_buyer")), "r_key_buyer").join(names.select(F.col("name").alias("other"), F.col("short").alias("n_key_buyer")), "n_key_buyer")
    pairs = pairs.where("name < other").select("name", "other", text.company_similarity(F.col("name"), F.col("other")).alias("similarity"))
    return pairs.where("similarity > 0")


NOTES = [
    "新增行情推送", "- 优化  登录体验", "支持iOS 12.0", "运行环境：android 8", "Fix crash and improve speed", "官网：http://a.b 升级", "本软件是一款致力于交易的应用，支持下单", "md5", "修", "下载地址", "修复已知问题",
    "1. 支持夜间模式", "股票交易平台升级", "欢迎各位联系，已优化", "www.a.com 新增", "", "·新增指标公式", "!!!???###$$$%%% 新增", "aaaa", "安全版本", "现已支持港股通", "支持多语言", "deadbeefdeadbeefdeadbeef00 优化 1.2.3",
    "deadbeefdeadbeefdeadbeef00 优化", "3）调整首页布局", "需要安卓 9 以上",
]
TAILS = ["", "，提升稳定性", " ", "。调整若干细节" * 15, "\n\t全新改版", "（客服电话 95500）"]
LOW_SQL = [
    "(?i)^(?:[-*•]\\s*)?(?:运行环境|系统要求|支持语言|适用客户|文件大小|下载地址|下载链接|md5(?:值)?|开发者|官方网站|官网|官方微信|热线电话|联系电话|联系方式)\\s*[：:]",
    "(?i)^(?:需要|支持)\\s*(?:ios|android|安卓|苹果|鸿蒙|harmonyos)\\s*[\\d.]+", "(?i)^(?:https?://|ftp://|www\\.)",
    "(?i)^(?:[-*•]\\s*)?(?:本软件|本产品|本应用).{0,40}(?:是一款|为用户提供|致力于|专注于提供)", "(?i)(?:手机版智能炒股软件|股票交易平台|一站式服务|专注于提供|欢迎.*联系)",
]
SHOWN_SQL = [
    "(?i)^(?:[-*]\\s*)?(?:运行环境|系统要求|支持语言|适用客户|文件大小|下载地址|下载链接|md5|开发者|官方网站|官方微信|热线电话)\\s*[：:]",
    "(?i)^(?:需要|支持)\\s*(?:iOS|Android|安卓|鸿蒙|HarmonyOS)\\s*[\\d.]+", LOW_SQL[4],
]
NOTE_SQL = f"{picked_sql('p_partkey', NOTES, 1)} || {picked_sql('p_partkey', TAILS, 5)}"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(picked("p_partkey", NOTES, 1), picked("p_partkey", TAILS, 5)).alias("note"))


@query(f"""
WITH t AS (SELECT p_partkey, {NOTE_SQL} AS note FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(note, '\\s+', ' ', 'g')) AS flat FROM t),
x AS (SELECT *, trim(regexp_replace(flat, '^(?:[-*•]\\s*)+', '')) AS x FROM c),
n AS (SELECT *, len(list_filter({listed(releases.CHANGE_WORDS)}, lambda w: contains(lower(x), w))) AS hits FROM x),
l AS (SELECT *, length(x) < 2 OR hits = 0 OR {" OR ".join(f"regexp_matches(x, '{p}')" for p in LOW_SQL)} AS low FROM n)
SELECT p_partkey, low AS low_value, (CASE WHEN low THEN -100 ELSE least(length(x), 180) // 10 + 10 * hits
         + CASE WHEN regexp_matches(x, '(?i)(修复|解决|新增|上线|支持|优化|升级|适配|改进|enhanc|fix|add|support|improv)') THEN 8 ELSE 0 END END)::INT AS score,
       flat <> '' AND NOT ({" OR ".join(f"regexp_matches(flat, '{p}')" for p in SHOWN_SQL)}) AS shown FROM l""")
def update_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release notes that are worth nothing, their scores, and what a client shows."""
    note = F.col("note")
    return _notes(spark, sf_dir).select("p_partkey", releases.low_value(note).alias("low_value"), releases.update_score(note).cast("int").alias("score"), releases.shown(note).alias("shown"))


@query(f"""
WITH t AS (SELECT p_partkey, {NOTE_SQL} AS note FROM part),
x AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(note, '^\\s*(?:[-*•·]\\s*|\\d+[.)、]\\s*)', ''), ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g') AS x FROM t),
m AS (SELECT *, lower(x) AS low, regexp_replace(x, '[^A-Za-z0-9\\x{{3400}}-\\x{{9fff}}]', '', 'g') AS meaning FROM x),
l AS (SELECT *, x = '' OR len(list_filter({listed([w.lower() for w in releases.SOURCE_LOW_VALUE])}, lambda w: contains(low, w))) > 0
        OR regexp_matches(low, '^(?:运行环境|系统要求|需要|支持|兼容)?[^。；;]{{0,24}}(?:ios|android|harmonyos|安卓|苹果)[^。；;]{{0,24}}(?:版本|以上|以下|及更高|及以上|[0-9]+(?:\\.[0-9]+){{0,2}})')
        OR regexp_matches(low, 'https?://|www\\.|(?:^|[：:]|\\s)md5(?:$|[：:]|\\s)')
        OR regexp_matches(low, '[0-9a-f]{{24,}}') AND NOT regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_])\\d+(?:\\.\\d+){{1,3}}(?:$|[^\\p{{L}}\\p{{N}}_])')
        OR length(meaning) < 2 OR replace(meaning, left(meaning, 1), '') = '' OR (length(x) - length(meaning) > 2 * length(meaning) AND length(x) > 8) AS low_value FROM m)
SELECT p_partkey, low_value, NOT low_value AND NOT list_contains({listed(releases.SOURCE_GENERIC)}, x)
         AND (len(list_filter({listed(releases.SOURCE_CHANGES)}, lambda w: contains(x, w))) > 0 OR
              length(x) <= 120 AND regexp_matches(x, '^(支持|现已支持|现在支持|正式支持)') AND NOT regexp_matches(x, '系统|语言|客户|版本')) AS tells_change FROM l""")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of a source that are metadata, and those that tell of a change."""
    return _notes(spark, sf_dir).select("p_partkey", releases.source_low_value(F.col("note")).alias("low_value"), releases.tells_change(F.col("note")).alias("tells_change"))


TITLES = ["行情系统升级项目", "合规监管平台续签", "办公用品采购", "投行质控数据库扩容", "柜台接口运维服务", "装修工程", "资讯终端", "车辆管理系统风控", "", "估值引擎", "风险管理咨询", "客户数据平台"]
CATEGORIES = ["专业及金融服务", " 专业及金融服务 ", "IT软硬件", ""]
SUBCATEGORIES = ["投行与资本市场", "业务系统与软件", "投行与资本市场 "]
LABEL_SQL = f"{picked_sql('p_partkey', TITLES, 1)} AS title, {picked_sql('p_partkey', CATEGORIES, 5)} AS category, {picked_sql('p_partkey', SUBCATEGORIES, 7)} AS subcategory"


@query(f"""
WITH t AS (SELECT p_partkey, {LABEL_SQL} FROM part),
k AS (SELECT *, title <> '' AND NOT regexp_matches(title, '工程装修|物业|保洁|法律服务|审计服务|办公用品|员工活动|餐饮|车辆|驾驶|印刷|广告制作')
         AND regexp_matches(title, '风控|风险管理|合规|反洗钱|监管|行情|金融数据|资讯|研报|投研|交易|柜台|清算|结算|估值|订单|投行|资本市场|质控')
         AND regexp_matches(title, '系统|平台|软件|应用|数据库|接口|引擎|网关|终端|内核|数据') AS known,
       trim(category) = '专业及金融服务' AND trim(subcategory) = '投行与资本市场' AND regexp_matches(title || subcategory, '投行|资本市场|质控|风控')
         AND regexp_matches(title || subcategory, '系统|平台|软件|内核|数据库|接口') AS renamed FROM t)
SELECT p_partkey, CASE WHEN known THEN 'IT软硬件' END AS own_category, CASE WHEN known THEN CASE WHEN regexp_matches(title, '续签|续约|续订|延续') THEN '续采续约'
         WHEN regexp_matches(title, '升级|改造|适配|优化') THEN '升级改造' WHEN contains(title, '扩容') THEN '扩容' WHEN regexp_matches(title, '维保|维护|运维') THEN '维保' ELSE '' END END AS action,
       CASE WHEN renamed THEN 'IT软硬件' ELSE category END AS category, CASE WHEN renamed THEN '业务系统与软件' ELSE subcategory END AS subcategory FROM k""")
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without a notice classified by their own text, and the renamed category."""
    title, category, subcategory = picked("p_partkey", TITLES, 1), picked("p_partkey", CATEGORIES, 5), picked("p_partkey", SUBCATEGORIES, 7)
    rows = table(spark, sf_dir, "part").select("p_partkey", text.standalone_class(title, title).alias("own"), text.legacy_category(category, subcategory, title, F.lit("")).alias("new"))
    return rows.select("p_partkey", F.col("own.category").alias("own_category"), "own.action", "new.category", "new.subcategory")


_ITEM = {"app_name": " 甲 ", "platform": None, "feature_tags": ["行情", " ", 7], "highlights": "单条", "more": 1}
ANSWERS = [
    json.dumps({"releases": [_ITEM, "not an object", {"app_version": 3}]}, ensure_ascii=False), json.dumps([_ITEM], ensure_ascii=False), json.dumps(_ITEM, ensure_ascii=False),
    '```json\n{"releases": []}\n```', '{"releases": 5}', "no JSON at all", '"text"', "[1, {}]",
]
_SAID = "'甲', '', '', '行情,7', '单条'"
_NONE = "'', '', '未知', '', ''"


@query(f"""
WITH want(kind, item, app_name, app_version, platform, tags, highlights, error) AS (VALUES
  (0, 0, {_SAID}, NULL), (0, 1, NULL, NULL, NULL, NULL, NULL, 'item[1] is no object'), (0, 2, '', '3', '未知', '', '', NULL), (1, 0, {_SAID}, NULL), (2, 0, {_SAID}, NULL),
  (4, NULL, NULL, NULL, NULL, NULL, NULL, 'answer holds no releases'), (5, NULL, NULL, NULL, NULL, NULL, NULL, 'answer holds no releases'), (6, NULL, NULL, NULL, NULL, NULL, NULL, 'answer holds no releases'),
  (7, 0, NULL, NULL, NULL, NULL, NULL, 'item[0] is no object'), (7, 1, {_NONE}, NULL))
SELECT p_partkey, item, app_name, app_version, platform, tags, highlights, error FROM part JOIN want ON kind = p_partkey % {len(ANSWERS)}""")
def release_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers as lists, envelopes or single items; an item that can't be read is an error row of its own."""
    rows = releases.release_items(table(spark, sf_dir, "part").select("p_partkey", picked("p_partkey", ANSWERS, 1).alias("answer")))
    join = lambda c: F.array_join(c, ",").alias("tags" if c == "feature_tags" else c)
    return rows.select("p_partkey", "item", "app_name", "app_version", "platform", join("feature_tags"), join("highlights"), "error")


@query("""
WITH u AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)
SELECT 'option' AS kind, o_orderpriority AS value, o_orderpriority IN ('1-URGENT', '5-LOW') AS selected, count(*) AS n FROM u GROUP BY 2
UNION ALL SELECT 'rows', '', true, count(*) FROM u WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'nothing left', '', true, count(*) FROM u""")
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """options of a facet under all other filters, stale selections dropped, rows under what is left of the selection."""
    orders = table(spark, sf_dir, "orders")
    others = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    rows, options = facets.self_excluding(orders, "o_orderpriority", others, ["1-URGENT", "5-LOW", "9-STALE"])
    every, _ = facets.self_excluding(orders, "o_orderpriority", others, ["9-STALE"])
    told = options.select(F.lit("option").alias("kind"), F.col("o_orderpriority").alias("value"), "selected", "n")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("value"), F.lit(True).alias("selected"), "n")
    return told.unionByName(count(rows, "rows")).unionByName(count(every, "nothing left"))


CURRENT = ["broker", "project", "is_broker", "category"]
CONTRACTS = {"current": [*CURRENT, "winner"], "previous": CURRENT, "legacy": ["broker", "project", "category"], "staging": ["broker", "project", "category", "record_key", "winner"]}


@query("""
WITH t AS (SELECT s_name AS broker, s_suppkey::VARCHAR AS project, CASE WHEN s_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, 'c' || s_nationkey AS category FROM supplier WHERE s_suppkey % 5 <> 0),
k AS (SELECT unnest(['current', 'previous', 'legacy', 'staging']) AS contract)
SELECT contract, broker, project, CASE WHEN contract IN ('legacy', 'staging') THEN 'true' ELSE flag END AS is_broker, category, CASE WHEN contract IN ('current', 'staging') THEN 'w' ELSE '' END AS winner FROM t, k""")
def contract_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four known headers read as one; blank rows are left out, the flag is checked or implied."""
    rows = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(
        F.col("s_name").alias("broker"), F.col("s_suppkey").cast("string").alias("project"), F.when(F.col("s_nationkey") % 2 == 0, " TRUE").otherwise("False").alias("is_broker"),
        F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("category"), F.lit("w").alias("winner"), F.lit("k").alias("record_key"),
    )
    blank = rows.limit(1).select(*[F.lit(" ").alias(c) for c in rows.columns])
    out = None
    for name, columns in CONTRACTS.items():
        path = work_folder(spark, "contract")
        publish.write_csv(rows.unionByName(blank), path, columns)
        read = files.contract_csv(spark, path, CONTRACTS, "is_broker", {"legacy", "staging"}).withColumn("contract", F.lit(name))
        out = read if out is None else out.unionByName(read)
    return out


RELEASE_COLUMNS = [
    "broker_code", "broker_name", "app_name", "source_url", "content_sha256", "crawl_time", "markdown_file", "processed_at", "app_version", "platform", "publish_date", "update_type",
    "update_summary", "feature_tags", "highlights",
]


@query("""
SELECT s_suppkey::VARCHAR AS broker_code, s_name AS broker_name, '' AS app_version, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'a' || s_nationkey || ',b' END AS tags, (s_suppkey % 3)::INT AS n_highlights FROM supplier""")
def release_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release table's fifteen columns in order, its lists read from JSON."""
    key = F.col("s_suppkey")
    tags = F.when(key % 3 == 0, "").otherwise(F.to_json(F.array(F.concat(F.lit(" a"), F.col("s_nationkey").cast("string")), F.lit("b"), F.lit(" "))))
    some = F.to_json(F.slice(F.array(F.lit("x"), F.lit('y "quoted", z')), 1, (key % 3).cast("int")))
    given = {"broker_code": key.cast("string"), "broker_name": F.col("s_name"), "feature_tags": tags, "highlights": some}
    rows = table(spark, sf_dir, "supplier").select(*[given.get(c, F.lit("")).alias(c) for c in RELEASE_COLUMNS])
    path = work_folder(spark, "releases")
    publish.write_csv(rows, path, RELEASE_COLUMNS)
    read = files.typed_csv(spark, path, RELEASE_COLUMNS, ["feature_tags", "highlights"], strict=True)
    return read.select("broker_code", "broker_name", "app_version", F.array_join("feature_tags", ",").alias("tags"), F.size("highlights").alias("n_highlights"))


SHOWN_NAMES = ["ＡＢ１（二期）  系统采购公告", "采购公告", " 平台 招标公告 ", "机房中标候选人公示", "ｘｙｚ 结果公示采购公告", "无后缀", ""]
SUPPLIERS = ['["甲公司", " 乙 ", "", null]', "丙  公司", '{"a": 1}', "[1, 2]", "[broken", "", "[]"]
CANDIDATES = ["甲；乙;  丙", ";;", "单一", "甲; ；乙 ", ""]
_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ（）"
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz()"


@query(f"""
WITH t AS (SELECT p_partkey, {picked_sql('p_partkey', SHOWN_NAMES, 1)} AS name, {picked_sql('p_partkey', SUPPLIERS, 3)} AS supplier, {picked_sql('p_partkey', CANDIDATES, 2)} AS candidates FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(translate(trim(name), '{_WIDE}', '{_PLAIN}'), '\\s+', ' ', 'g'), '^(.+)(采购公告|招标公告|结果公告|结果公示|中标公告|成交公告|流标公告|废标公告|候选人公示)$', '\\1')) AS name,
       CASE supplier WHEN '["甲公司", " 乙 ", "", null]' THEN '甲公司、乙' WHEN '[1, 2]' THEN '1、2' WHEN '[]' THEN '' ELSE regexp_replace(supplier, '\\s+', ' ', 'g') END AS supplier,
       array_to_string(list_filter(list_transform(string_split_regex(candidates, '[;；]\\s*'), lambda x: trim(x)), lambda x: x <> ''), '; ') AS candidates FROM t""")
def shown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, suppliers and candidates as they are shown."""
    name, supplier, candidates = picked("p_partkey", SHOWN_NAMES, 1), picked("p_partkey", SUPPLIERS, 3), picked("p_partkey", CANDIDATES, 2)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.display_name(name).alias("name"), values.supplier_text(supplier).alias("supplier"), values.candidate_text(candidates).alias("candidates")
    )


@query("""
SELECT n_nationkey, i, CASE WHEN n_nationkey % 3 = 2 THEN 'all' WHEN i = 0 THEN n_name WHEN i = 1 THEN 'Other app' ELSE 'all' END AS app,
       CASE WHEN n_nationkey % 3 = 2 THEN 'no heading ' || n_name WHEN i = 0 THEN '## Shop·' || n_name || chr(10) || 'one' || chr(10) || chr(10) || 'two' WHEN i = 1 THEN '##  Other app ' || chr(10) || '### three' ELSE '## Shop·' END AS body
FROM nation, (SELECT unnest(range(3))::INT AS i) WHERE i = 0 OR n_nationkey % 3 <> 2""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at their headings, each part named by its app."""
    name = F.col("n_name")
    document = F.when(F.col("n_nationkey") % 3 == 2, F.concat(F.lit("no heading "), name)).otherwise(
        F.concat(F.lit("intro\n## Shop·"), name, F.lit("\none\n\ntwo\n\n##  Other app \n### three\n## Shop·\n"))
    )
    parts = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(text.sections(document, F.lit("all"))).alias("i", "part"))
    return parts.select("n_nationkey", "i", "part.app", "part.body")


@query("""
WITH t AS (SELECT o_orderkey, ['pending', 'running', 'succeeded', 'failed'][o_orderkey % 4 + 1] AS status, ['succeeded', 'running', NULL][o_orderkey % 3 + 1] AS search_status,
             CASE WHEN o_orderkey % 5 = 0 THEN 'kept' END AS completed_at FROM orders)
SELECT o_orderkey, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status,
       CASE WHEN status IN ('pending', 'running') AND search_status IS DISTINCT FROM 'succeeded' THEN 'failed' ELSE search_status END AS search_status,
       CASE WHEN status NOT IN ('pending', 'running') THEN 'was' WHEN search_status = 'succeeded' THEN 'failed' ELSE 'not_run' END AS analysis_status,
       CASE WHEN status IN ('pending', 'running') THEN coalesce(completed_at, 'now') ELSE completed_at END AS completed_at FROM t""")
def stale_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stopped process left open, marked as failed by two rules that exclude each other."""
    pick = lambda options: F.element_at(F.array(*[F.lit(x) for x in options]), (F.col("o_orderkey") % len(options) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(["pending", "running", "succeeded", "failed"]).alias("status"), pick(["succeeded", "running", None]).alias("search_status"),
        F.lit("was").alias("analysis_status"), F.when(F.col("o_orderkey") % 5 == 0, "kept").alias("completed_at"),
    )
    return keyed.stale_recovered(rows, F.lit("now"))


@query("""
SELECT * FROM (VALUES ('nation_7', 'exact', 'NATION_7'), ('N6', 'exact', 'NATION_6'), (' land-c ', 'prefix', 'NATION_2'), ('nation_', 'ambiguous', NULL), ('zz', 'unknown', NULL)) AS t(selector, status, name)""")
def name_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names chosen by alias or by how they begin, with ambiguous and unknown ones told."""
    nations = table(spark, sf_dir, "nation")
    names = nations.select(F.col("n_name").alias("name"), F.explode(F.array("n_name", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("Land-"), F.char(F.col("n_nationkey") + 65), F.lit("x")))).alias("alias"))
    return links.resolved_selectors(["nation_7", "N6", " land-c ", "nation_", "zz", " ", "nation_7"], names)


@query("SELECT o_orderkey, (o_orderdate - INTERVAL 3 MONTH)::DATE AS since FROM orders")
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three months before a date, at that month's last day where it is shorter."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months("o_orderdate", -3).alias("since"))

"""Answers, pages and documents taken apart, and the sinks that give them out, each beside its SQL.

Bodies are put together from a few forms by row number; the SQL states what each form must give.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.flows import work_folder
from tidewell.catalog.labels import picked
from tidewell.catalog.registry import query, table
from tidewell.functions import markup
from tidewell.operators import keyed
from tidewell.sources import files, payloads, publish


def dumped(x: object) -> str:
    return json.dumps(x, ensure_ascii=False)


RESULTS = [
    dumped([{"title": "甲平台中标公告", "winner": " 甲公司 ", "winning_amount": "1.5万元", "section_number": 2}, "no record", {"title": "乙成交结果公告", "result_type": "Candidate", "winner": "乙"}]),
    dumped({"records": [{"title": "丙系统（中标候选人公示）", "winner": "丙", "winner_candidates": ["丙", " ", "丁"], "project_number": "N-1"}], "title": "unused"}),
    dumped({"title": "戊流标公告", "project_name": "戊 终止公告 - 结果公告", "result_status": "已中标", "winning_amount": 7, "source_file": "own.md"}),
    "not JSON", "[]", dumped({"result_type": "terminated", "winner": "己", "winner_candidates": "己、庚", "winning_amount": "unknown"}),
]


@query(f"""
WITH want(kind, item, title, project_name, project_number, package_number, result_type, winner, winner_candidates, winning_amount, result_status, own_file) AS (VALUES
  (0, 0, '甲平台中标公告', '甲平台', '', '2', 'winning', '甲公司', '', 15000::DECIMAL(20,2), '已中标', NULL), (0, 1, '乙成交结果公告', '乙', '', '', 'candidate', '', '', NULL, '候选人公示', NULL),
  (1, 0, '丙系统（中标候选人公示）', '丙系统（中标候选人公示）', 'N-1', '', 'candidate', '', '["丙","丁"]', NULL, '候选人公示', NULL),
  (2, 0, '戊流标公告', '戊', '', '', 'failed', '', '', 7, '已中标', 'own.md'), (3, 0, 'head', 'head', '', '', 'other', '', '', NULL, '未知', NULL), (4, 0, 'head', 'head', '', '', 'other', '', '', NULL, '未知', NULL),
  (5, 0, 'head', 'head', '', '', 'terminated', '己', '己、庚', NULL, '终止', NULL))
SELECT p_partkey, item, title, 'n' || p_partkey AS notice_id, project_name, project_number, package_number, result_type, winner, winner_candidates, winning_amount, result_status,
       coalesce(own_file, p_name) AS source_file FROM part JOIN want ON kind = p_partkey % {len(RESULTS)}""")
def result_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result answers as rows, what they lack taken from the front matter; a stub where there is no record."""
    head = F.create_map(F.lit("title"), F.lit("head"), F.lit("notice_id"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", picked("p_partkey", RESULTS, 1).alias("payload"), head.alias("meta"))
    shown = ["title", "notice_id", "project_name", "project_number", "package_number", "result_type", "winner", "winner_candidates", "winning_amount", "result_status", "source_file"]
    return payloads.result_rows(rows, "payload", "meta", "p_name").select("p_partkey", "item", *shown)


PAGES = [
    ("<h2> {n} </h2><style>x</style><p>one <b>two</b> &amp; <a href='/u'>three</a></p><p> </p>", "## {n}\n\none **two** & [three](/u)"),
    ("<div><p>{n}</p><ul><li>a<li2></li2></li><li><p>b</p><p>c</p></li></ul></div>", "{n}\n\n- a\n- b\n\nc"),
    ("<table><tr><th>{n}</th><th>k</th></tr><tr><td>x|y<br>z</td></tr><tr><td> </td></tr></table>", "| {n} | k |\n| --- | --- |\n| x\\|y<br>z | |"),
    ("<ol><li>{n}</li><li><em>i</em></li></ol><script>if (a < b) '</p>'</script>[if !supportLists]end[endif]", "1. {n}\n2. *i*\n\nend"),
    ("{n}<br>\xa0next<strong>", "{n}\n\nnext"), ("<p></p>", "plain {n}"), ("", "plain {n}"),
]


def _page_sql(i: int) -> str:
    cases = " ".join(f"WHEN {k} THEN '" + p[i].replace("'", "''") + "'" for k, p in enumerate(PAGES))
    return f"replace(CASE p_partkey % {len(PAGES)} {cases} END, '{{n}}', p_name)"


@query(f"SELECT p_partkey, {_page_sql(1)} AS markdown, p_partkey % {len(PAGES)} >= {len(PAGES) - 2} AS warned FROM part")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, their plain text where nothing is left of them."""
    page = F.replace(picked("p_partkey", [p[0] for p in PAGES], 1), F.lit("{n}"), "p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", markup.html_markdown(page, F.concat(F.lit(" plain "), "p_name")).alias("m"))
    return rows.select("p_partkey", "m.markdown", F.col("m.warning").isNotNull().alias("warned"))


BASE, DOWNLOAD = "http://notices.example", "/download.do"
DETAILS = [
    dumped({"rows": [{"id": 7, "noticeTitle": "", "userName": "甲", "noticeContent": "&lt;p&gt;x&lt;/p&gt;", "file": dumped([{"fileName": " a b.pdf ", "fileUrl": "/f/1~*.pdf"}, {"fileName": "", "fileUrl": " "}, {"fileUrl": "http://o.example/q?a=1+2"}])}]}),
    dumped({"rows": [{"area": "北京", "file": "broken"}, {"area": "unused"}]}), dumped({"rows": []}), "no JSON",
]


@query(f"""
WITH want(kind, notice_id, title, purchaser, region, content_html, names, urls) AS (VALUES
  (0, '7', NULL, '甲', '上海', '<p>x</p>', 'a b.pdf|', '{BASE}{DOWNLOAD}?downloadUrl=http%3A%2F%2Fnotices.example%2Ff%2F1~%2A.pdf&realFileName=a%20b.pdf|{BASE}{DOWNLOAD}?downloadUrl=http%3A%2F%2Fo.example%2Fq%3Fa%3D1%2B2&realFileName='),
  (1, NULL, NULL, '', '北京', 'brief', '', ''), (2, NULL, NULL, '', '上海', 'brief', '', ''), (3, NULL, NULL, '', '上海', 'brief', '', ''))
SELECT s_suppkey, coalesce(notice_id, s_suppkey::VARCHAR) AS notice_id, coalesce(title, s_name) AS title, purchaser, region, content_html, names, urls FROM supplier JOIN want ON kind = s_suppkey % {len(DETAILS)}""")
def notice_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail answers beside their list items, and the files that they name."""
    item = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("noticeTitle"), F.lit("上海").alias("area"), F.lit("brief").alias("briefContent")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", picked("s_suppkey", DETAILS, 1).alias("detail"), item.alias("list_item"))
    out = payloads.notice_detail(rows, "detail", "list_item", BASE, DOWNLOAD)
    joined = lambda k: F.array_join(F.transform("attachments", lambda x: x[k]), "|").alias(f"{k}s")
    return out.select("s_suppkey", "notice_id", "title", "purchaser", "region", "content_html", joined("name"), joined("url"))


SOFTWARE = dumped({
    "data": {"ios": [{"name": "A", "ver": "1.0", "time": "2024-01-02 10:00"}, None, {"name": "B"}], "empty": []},
    "results": [{"softid": "1", "title": "old", "version": "1"}, {"softid": 1, "title": "new", "version": "2", "modify_date": "2024-03-04T00:00"}],
})
CLIENTS = dumped({"data": [
    {"adaptClient": " phone ", "downloadName": "C", "softUpdateTime": "2024-05-06", "verionList": [{"softDownUrl": " u1 "}, {"versionType": "apk", "softDownUrl": ""}, {"versionType": "ipa", "softDownUrl": "u2"}]},
    {"adaptClient": "pc", "downloadName": "D"}, {"downloadName": "E"},
]})


@query("""
SELECT n_nationkey, parser, label, name, version, released::DATE AS released, extra FROM nation, (VALUES
  ('groups', 'iOS', 'A', '1.0', '2024-01-02', NULL), ('groups', 'iOS', 'B', NULL, NULL, NULL), ('groups', 'Android', NULL, NULL, NULL, 'no group absent'), ('groups', 'HarmonyOS', NULL, NULL, NULL, 'no group empty'),
  ('apps', 'App', 'new', '2', '2024-03-04', 'true'), ('apps', 'Other', 'Other', NULL, NULL, 'false'), ('clients', '', 'C', NULL, '2024-05-06', '下载 u1,ipa u2')) AS t(parser, label, name, version, released, extra)""")
def software_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms of software lists; what is missing is told, not left out."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(SOFTWARE).alias("body"), F.lit(CLIENTS).alias("clients"))
    groups = payloads.platform_groups(rows, "body", {"iOS": "ios", "Android": "absent", "HarmonyOS": "empty"})
    apps = payloads.clients_by_app(rows, "body", {"App": "1", "Other": "9"})
    clients = payloads.mobile_clients(rows, "clients", ["phone", "pad"])
    links = F.array_join(F.transform("downloads", lambda d: F.concat_ws(" ", d["type"], d["url"])), ",")
    shown = lambda df, parser, label, version, extra: df.select("n_nationkey", F.lit(parser).alias("parser"), label.alias("label"), "name", version.alias("version"), "released", extra.alias("extra"))
    out = shown(groups, "groups", F.col("platform"), F.col("version"), F.col("error")).unionByName(shown(apps, "apps", F.col("app"), F.col("version"), F.col("found").cast("string")))
    return out.unionByName(shown(clients, "clients", F.lit(""), F.lit(None).cast("string"), links))


@query("""
SELECT s_suppkey, '{"messages":[{"role":"user","content":"' || s_name || ' \\"news\\""}],"search_source":"web_v2","search_recency_filter":"month","resource_type_filter":[{"type":"web","top_k":'
       || greatest(1, least(10, s_nationkey - 3)) || '}]}' AS request FROM supplier""")
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a search, with the number of answers held within its bounds."""
    request = payloads.search_request(F.concat("s_name", F.lit(' "news"')), F.lit("month"), F.col("s_nationkey") - 3, "web_v2")
    return table(spark, sf_dir, "supplier").select("s_suppkey", request.alias("request"))


@query("""
SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '') AS status, (SELECT count(*) FROM orders) AS said, 'v1' AS version, '2024' AS updated_at FROM orders""")
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown fields as compressed JSON with their count; the same version is built once, whatever is asked of it later."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_totalprice")
    root = work_folder(spark, "response")
    publish.write_response(rows, root, ["o_orderkey", "status", "absent"], "v1", "2024")
    meta = publish.write_response(rows.limit(0), root, ["o_orderkey", "status", "absent"], "v1", "2025").first()
    records = spark.read.schema("o_orderkey string, status string").json(meta["path"])
    return records.select("*", F.lit(meta["count"]).alias("said"), F.lit(meta["version"]).alias("version"), F.lit(meta["updated_at"]).alias("updated_at"))


@query("""
SELECT c_custkey::VARCHAR AS c_custkey, upper(c_name) AS c_name, kind, (SELECT count(*) FROM customer) AS said FROM customer, (VALUES ('csv'), ('lines')) AS t(kind)""")
def output_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made alike and sorted, as CSV and as JSON lines beside a summary."""
    root = work_folder(spark, "bundle")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    said = publish.write_bundle(rows, root, ["c_custkey", "c_name"], lambda df: df.withColumn("c_name", F.upper("c_name")), [F.desc("c_name"), F.asc("c_custkey")]).first()
    csv = files.csv_text(spark, said["csv_path"], ["c_custkey", "c_name"]).withColumn("kind", F.lit("csv"))
    lines = spark.read.schema("c_custkey string, c_name string").json(said["lines_path"]).withColumn("kind", F.lit("lines"))
    return csv.unionByName(lines).withColumn("said", F.lit(said["n_rows"]))


@query("""
SELECT 'seed' AS name, count(*) AS n_rows, count(*) FILTER (s_suppkey % 3 = 0) AS n_true, count(*) FILTER (s_suppkey % 3 <> 0) AS n_false, count(*) AS archived FROM supplier""")
def seed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed read by its contract, kept as it was, written anew and counted."""
    columns = ["id", "name", "is_broker"]
    flag = F.when(F.col("s_suppkey") % 3 == 0, " TRUE").otherwise("false")
    path, root = work_folder(spark, "source"), work_folder(spark, "seed")
    publish.write_csv(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), flag.alias("is_broker")), path, columns)
    rows = files.contract_csv(spark, path, {"seed": columns}, "is_broker")
    manifest = publish.import_seed(rows, files.csv_text(spark, path), root, "is_broker")
    return manifest.select("name", "n_rows", "n_true", "n_false", F.lit(spark.read.parquet(f"{root}/archive").count()).alias("archived"))


@query("""
SELECT 'procurement' AS notice_type, 'i' || o_custkey AS notice_id, min(lpad(o_orderkey::VARCHAR, 12, '0')) AS path, count(*) FILTER (false) AS n_blank FROM orders
WHERE o_orderkey % 3 < 2 AND o_custkey % 5 <> 0 GROUP BY o_custkey""")
def notice_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by notice id, the first path of each; those without a type count as procurement, those without an id don't."""
    kind = F.element_at(F.array(F.lit("procurement"), F.lit(""), F.lit("result")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    ident = F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("i"), F.col("o_custkey").cast("string")))
    meta = F.create_map(F.lit("notice_type"), kind, F.lit("notice_id"), ident, F.lit("title"), F.lit("t"))
    rows = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), meta.alias("meta"))
    return files.notice_index(rows, "procurement").select("notice_type", "notice_id", "path", F.when(F.col("title") == "", 1).otherwise(0).cast("long").alias("n_blank"))


@query("""
SELECT n_nationkey::VARCHAR AS key, n_name AS broker_name, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE n_nationkey END::INT AS pages, 10 AS page_size, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS ratio, '' AS aliases
FROM nation WHERE n_regionkey <> 2""")
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of a JSON document that are in use, typed, with defaults and bounds."""
    key = F.col("n_nationkey")
    row = F.struct(
        key.cast("string").alias("key"), F.col("n_name").alias("broker_name"), F.lit("list").alias("collector"), (F.col("n_regionkey") != 2).alias("enabled"),
        F.when(key % 4 == 0, F.lit(-5)).otherwise(key.cast("int")).alias("pages"), F.when(key % 2 == 0, F.lit(7.5)).alias("min_detail_success_ratio"),
    )
    path = work_folder(spark, "sources")
    table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(row).alias("brokers"))).alias("value")).coalesce(1).write.text(path)
    return files.source_catalog(spark, path).select("key", "broker_name", "pages", "page_size", F.col("min_detail_success_ratio").alias("ratio"), F.array_join("aliases", ",").alias("aliases"))


@query("""
WITH t AS (SELECT p_partkey AS key, p_partkey % 4 AS held, p_partkey % 6 = 0 AS fails FROM part)
SELECT key, CASE WHEN held = 1 THEN '{"old":1}' WHEN fails THEN NULL ELSE '{"new":1}' END AS answer, CASE WHEN held <> 1 AND fails THEN 'refused' END AS error,
       CASE WHEN held = 1 THEN '{"old":1}' WHEN NOT fails THEN '{"new":1}' WHEN held = 2 THEN '{"cut' END AS kept FROM t""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is asked what the cache can't answer; an unreadable answer counts as none, and a refusal destroys nothing."""
    inputs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    cache = inputs.where("key % 4 IN (1, 2)").withColumn("answer", F.when(F.col("key") % 4 == 1, '{"old":1}').otherwise('{"cut'))
    fails = F.col("key") % 6 == 0
    ask = lambda df: df.withColumn("answer", F.when(~fails, '{"new":1}')).withColumn("error", F.when(fails, "refused"))
    answers, after = keyed.answered(inputs, cache, ask)
    return answers.join(after.select("key", F.col("answer").alias("kept")), "key", "left")

"""Smaller operators, each over rows of the tables: addresses, people, keys, documents of several kinds, caches, resumed reading, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.labels import picked, picked_sql
from tidewell.catalog.registry import query, table
from tidewell.functions import text, values
from tidewell.operators import gates, keyed
from tidewell.plans import linkage, questions, reports, research
from tidewell.sources import fetch, files, paged, publish, shared
from tidewell.sources.shared import fresh_folder

CONTACTS = ["张三：13800138000", "李四 021-12345678、010-1234567 / ", "13800138000 13800138000", "王五,", "", "无电话 12345", "赵六 0755-12345678：13900139000、"]
SECRETS = ["sk-123456", "ab", "", "abc"]
EMAILS = [" User@Example.COM ", "a@b.c", "no mail", "x@y@z"]
QUESTIONS = ["券商 与 银行、基金，AI 及 风控", "AB,cd", "和", "", "Mixed Case"]
NAMES = ["ＡＢ１２ ", "a/b:c*d?", "x" * 90, "ﬁ（二）", ' "q"|<r> ']
WORDS = ["true", " 是", "NO", "否", "maybe", "", "1"]
DOCUMENTS = ["# 标题 \nbody", "no title", "text\n#  B  \n# C", "##x\n# y"]


@query(f"""
WITH c AS (SELECT c_custkey, {picked_sql('c_custkey', CONTACTS, 3)} AS contact, {picked_sql('c_custkey', SECRETS, 1)} AS secret, {picked_sql('c_custkey', EMAILS, 5)} AS email, {picked_sql('c_custkey', QUESTIONS, 7)} AS question FROM customer),
p AS (SELECT *, regexp_extract_all(contact, '0[0-9]{{2,3}}-[0-9]{{7,8}}|[0-9]{{11}}') AS every FROM c)
SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace(contact, '0[0-9]{{2,3}}-[0-9]{{7,8}}|[0-9]{{11}}', '', 'g'), '[：:,\\s、/]+$', '')), '') AS person,
       nullif(array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '、'), '') AS phones,
       CASE WHEN secret = '' THEN '' WHEN length(secret) > 2 THEN left(secret, 2) || repeat('•', 14) ELSE repeat('•', 16) END AS masked, lower(trim(email)) AS email_key, string_split(email, '@')[1] AS username,
       CASE WHEN regexp_matches(email, '^.+@') THEN left(email, 1) || '***@' || regexp_extract(email, '.*@(.*)$', 1) ELSE email END AS masked_email, lower(regexp_replace(question, '[\\s、，,与和及]+', '', 'g')) AS query_key FROM p""")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and phones apart, masked secrets and addresses, keys of questions."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[picked("c_custkey", p, k).alias(n) for n, p, k in (("contact", CONTACTS, 3), ("secret", SECRETS, 1), ("email", EMAILS, 5), ("question", QUESTIONS, 7))])
    both = text.people_and_phones(F.col("contact"))
    return rows.select(
        "c_custkey", both["person"].alias("person"), both["phones"].alias("phones"), text.mask_secret(F.col("secret")).alias("masked"), text.email_key(F.col("email")).alias("email_key"),
        text.username(F.col("email")).alias("username"), text.mask_email(F.col("email")).alias("masked_email"), text.query_key(F.col("question")).alias("query_key"),
    )


@query(f"""
WITH n AS (SELECT p_partkey, {picked_sql('p_partkey', NAMES, 1)} AS name, {picked_sql('p_partkey', WORDS, 3)} AS word, {picked_sql('p_partkey', DOCUMENTS, 5)} AS document FROM part)
SELECT p_partkey, trim(replace(translate(name, 'ＡＢ１２（）', 'AB12()'), 'ﬁ', 'fi')) AS nfkc, left(trim(regexp_replace(name, '[\\\\/:*?"<>|\\x00-\\x1f]+', '_', 'g')), 72) AS file_name,
       CASE WHEN lower(trim(word)) IN ('true', '1', 'yes', 'y', '是') THEN true WHEN lower(trim(word)) IN ('false', '0', 'no', 'n', '否') THEN false END AS said,
       nullif(regexp_extract(document, '(?m)^#\\s+(.+?)\\s*$', 1), '') AS title FROM n""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility form, names of files, yes and no, titles."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *[picked("p_partkey", p, k).alias(n) for n, p, k in (("name", NAMES, 1), ("word", WORDS, 3), ("document", DOCUMENTS, 5))])
    return rows.select(
        "p_partkey", text.nfkc(F.col("name")).alias("nfkc"), text.portable_name(F.col("name")).alias("file_name"), values.tri_state(F.col("word")).alias("said"), text.markdown_title(F.col("document")).alias("title")
    )


@query("""
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://u:p@') WHEN 2 THEN 'http://localhost/' || page_id WHEN 3 THEN 'ftp' || url WHEN 4 THEN 'http://10.0.0.1/x' ELSE 'no address' END AS url FROM pages)
SELECT page_id, regexp_matches(url, '^(?i:https?)://') AND NOT regexp_matches(url, '^[^/]+//[^/?#]*@') AND NOT regexp_matches(url, '://(localhost|127\\.|10\\.|192\\.168\\.)') AS public FROM u""")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses that may be shown: http(s), without credentials, not local."""
    key, url = F.col("page_id"), F.col("url")
    shown = F.when(key % 6 == 0, url).when(key % 6 == 1, F.replace(url, F.lit("://"), F.lit("://u:p@"))).when(key % 6 == 2, F.concat(F.lit("http://localhost/"), key.cast("string")))
    shown = shown.when(key % 6 == 3, F.concat(F.lit("ftp"), url)).when(key % 6 == 4, "http://10.0.0.1/x").otherwise("no address")
    return table(spark, sf_dir, "pages").select("page_id", values.is_public_url(shown).alias("public"))


@query("""
WITH i AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'analysis' ELSE 'recommendation' END AS kind, [o_custkey, o_custkey + 1, -1] AS ids FROM orders),
m AS (SELECT max(c_custkey) AS most FROM customer),
k AS (SELECT o_orderkey, kind, list_filter(ids, lambda x: x % 4 = 0 AND x >= 0 AND x <= most) AS ids FROM i, m)
SELECT o_orderkey::VARCHAR AS item_id, kind, array_to_string(list_sort(list_transform(ids, lambda x: x::VARCHAR)), ',') AS source_ids FROM k WHERE kind = 'recommendation' OR len(ids) > 0""")
def grounded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: items keep the sources that are known; facts and analyses without any are dropped."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    ids = F.array(*[x.cast("string") for x in (owner, owner + 1, F.lit(-1))])
    items = table(spark, sf_dir, "orders").select(key.cast("string").alias("item_id"), F.when(key % 3 == 0, "fact").when(key % 3 == 1, "analysis").otherwise("recommendation").alias("kind"), ids.alias("source_ids"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("source_id"))
    return research.grounded(items, known).select("item_id", "kind", F.array_join("source_ids", ",").alias("source_ids"))


@query("SELECT coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END, ' '), 'unknown') AS folder, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def owners_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each owner, one for rows without, read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("owner"))
    path = fresh_folder(spark, "owners")
    publish.write_by_folder(rows, path, "owner")
    return spark.read.parquet(path).groupBy(F.col("_folder").alias("folder")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT 'lines' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'csv', count(*) FROM region")
def lines_or_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, or the CSV twin where they hold no row."""
    nation, region, root = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), fresh_folder(spark, "bundle")
    nation.select(F.col("n_nationkey").cast("string").alias("id")).write.json(f"{root}/full.jsonl")
    nation.limit(0).select(F.col("n_nationkey").cast("string").alias("id")).write.json(f"{root}/empty.jsonl")
    publish.write_csv(region.select(F.col("r_regionkey").cast("string").alias("id")), f"{root}/twin.csv", ["id"])
    count = lambda kind, lines: files.json_lines_or_csv(spark, f"{root}/{lines}", f"{root}/twin.csv", ["id"]).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("lines", "full.jsonl").unionByName(count("csv", "empty.jsonl"))


@query("""
SELECT * FROM (VALUES ('cut_cache', NULL, 'unreadable'), ('cut_state', 0, NULL), ('good', (SELECT count(*) FROM nation), NULL), ('listed', NULL, 'no object'), ('no_cache', NULL, 'missing'), ('no_state', 0, NULL)) AS t(name, n, error)""")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON documents, one of all nations; what is missing or broken is a default for a state, an error for a cache."""
    nations, root = table(spark, sf_dir, "nation"), fresh_folder(spark, "documents")
    whole = nations.agg(F.to_json(F.struct(F.collect_list("n_name").alias("names"))).alias("value"))  # nations are few
    texts = {"good": F.col("value"), "cut_cache": F.substring("value", 1, 20), "cut_state": F.substring("value", 1, 20), "listed": F.lit("[1]")}
    for name, value in texts.items():
        whole.select(value.alias("value")).coalesce(1).write.text(f"{root}/parts/{name}")
        fs, _ = shared.file_system(spark, root)
        part = next(x for x in shared.names(spark, f"{root}/parts/{name}") if x.startswith("part-"))
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs.rename(path(f"{root}/parts/{name}/{part}"), path(f"{root}/{name}.json"))
    state = '{"names": []}'
    found = files.json_documents(spark, root, {"good": None, "cut_cache": None, "cut_state": state, "listed": None, "no_cache": None, "no_state": state})
    return found.select("name", F.size(F.try_variant_get("document", "$.names", "array<string>")).cast("long").alias("n"), "error")


@query("""
SELECT o_orderkey::VARCHAR AS r_id, CASE WHEN o_orderkey % 4 = 0 THEN 'cached' WHEN o_totalprice > 150000 THEN 'matched' ELSE 'unmatched' END AS decision, o_orderkey % 4 <> 0 AS asked FROM orders WHERE o_orderstatus = 'P'""")
def decisions_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose decision is kept by content aren't asked again."""
    key = F.col("o_orderkey").cast("string")
    pairs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        key.alias("r_id"), F.concat(F.lit("n"), key).alias("n_id"), F.when(F.col("o_totalprice") > 150000, 0.9).otherwise(0.5).alias("score"), F.lit("t").alias("r_title"), F.lit("u").alias("n_title"), (F.col("o_orderkey") % 4 == 0).alias("_kept")
    )
    digest = values.fingerprint(F.col("r_id"), F.col("n_id"), F.col("r_title"), F.col("n_title"), F.lit("v1"))
    cache = pairs.where("_kept").select(digest.alias("pair_hash"), F.lit("cached").alias("decision"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("error"))
    answers, fresh = linkage.asked_once(pairs.drop("_kept"), cache, "v1")
    return answers.join(fresh.select("pair_hash", F.lit(True).alias("_new")), "pair_hash", "left").select("r_id", "decision", F.coalesce("_new", F.lit(False)).alias("asked"))


@query("SELECT (c_custkey % 12)::INT AS page, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a source collected over two runs: the first comes as far as its pages go, the second reads what is left."""
    root = fresh_folder(spark, "collected")
    items = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 12).cast("int").alias("page"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"))
    items.write.partitionBy("page").json(f"{root}/pages")
    paged.collected(spark, {"path": f"{root}/pages", "pages": "7"}, f"{root}/run")
    out = paged.collected(spark, {"path": f"{root}/pages", "pages": "12"}, f"{root}/run")
    return out.groupBy("page").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("keys"))


@query("""
SELECT s_suppkey::VARCHAR AS execution, CASE s_suppkey % 5 WHEN 3 THEN 'core judgment without a source' WHEN 4 THEN 'not JSON' END AS error,
       CASE s_suppkey % 5 WHEN 0 THEN 'core_judgment 1 fact ' || s_name || ' [a,b]|key_developments 1 fact k [a]|risks_and_watch_items 1 recommendation w []' WHEN 1 THEN 'core_judgment 1 analysis ' || s_name || ' [b]'
         WHEN 2 THEN 'company_implications 1 recommendation ' || s_name || ' []|core_judgment 1 analysis c [a]' END AS items,
       CASE s_suppkey % 5 WHEN 0 THEN '未找到引用来源：zz' WHEN 1 THEN '存在未引用来源的事实或分析项' WHEN 3 THEN '存在未引用来源的事实或分析项' ELSE '' END AS warnings FROM supplier""")
def model_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers' reports in the present and older shapes; citations by alias or id, ungrounded items dropped with a warning."""
    key, name = F.col("s_suppkey"), F.col("s_name")
    one = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    lit = F.lit
    answer = (
        F.when(key % 5 == 0, F.to_json(one(core_judgment=F.array(one(type=lit("fact"), text=name, source_ids=ids("a", "[2]", "zz"))), key_developments=one(items=F.array(one(summary=lit("k"), source_ids=ids("a")))), watch_items=ids("w"))))
        .when(key % 5 == 1, F.concat(lit("```json\n"), F.to_json(one(core_conclusion=one(text=F.concat(lit("<b>"), name, lit("</b>")), source_ids=ids("[2]")), key_dynamics=lit("no source"))), lit("\n```")))
        .when(key % 5 == 2, F.to_json(one(core_judgment=one(text=lit("c"), source_ids=ids("a")), focus_sections=F.array(one(type=lit("recommendation"), text=name)))))
        .when(key % 5 == 3, F.to_json(one(core_judgment=F.array(one(type=lit("recommendation"), text=name, source_ids=ids())), impact_analysis=lit("x")))).otherwise("no JSON")
    )
    answers = shared.written(table(spark, sf_dir, "supplier").select(key.cast("string").alias("execution"), answer.alias("answer")), "answers")
    sources = answers.select("execution", F.explode(ids("a", "b")).alias("source_id")).withColumn("url", F.lit("http://a.b/c"))
    aliases = answers.select("execution", F.lit("[2]").alias("alias"), F.lit("b").alias("source_id"))
    told, items = reports.normalized(answers, sources, aliases)
    said = F.concat_ws(" ", "section", F.col("place").cast("string"), "type", "text", F.concat(F.lit("["), F.array_join("source_ids", ","), F.lit("]")))
    held = items.groupBy("execution").agg(F.array_join(F.sort_array(F.collect_list(said)), "|").alias("items"))
    return told.join(held, "execution", "left").select("execution", "error", "items", F.array_join("warnings", "|").alias("warnings"))


@query("""
WITH r AS (SELECT l_suppkey, md5(l_orderkey::VARCHAR || chr(31) || l_linenumber || chr(31) || l_returnflag) AS h FROM lineitem)
SELECT l_suppkey, count(*) || '-' || sum(('0x' || h[1:15])::HUGEINT) || '-' || sum(('0x' || h[16:30])::HUGEINT) AS digest FROM r GROUP BY 1""")
def group_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each group's rows that needs no list of them."""
    return keyed.group_digest(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("""
SELECT s_suppkey::VARCHAR AS execution, CASE s_suppkey % 6 WHEN 3 THEN 'too few queries' WHEN 4 THEN 'no intent' WHEN 5 THEN 'not JSON' END AS error, CASE WHEN s_suppkey % 6 < 4 THEN s_name WHEN s_suppkey % 6 = 4 THEN '' END AS intent,
       CASE s_suppkey % 6 WHEN 0 THEN '1 q ' || s_name || ' (p)|2 b (规划方向)' WHEN 1 THEN '1 one (d)|2 two (规划方向)|3 three (规划方向)|4 4 (规划方向)|5 5 (规划方向)' WHEN 2 THEN '1 a (规划方向)|2 ' || s_name || ' (规划方向)' END AS queries FROM supplier""")
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of queries in four shapes, repeats and queries that only put tags together left out, two to five kept."""
    key, name, lit, js = F.col("s_suppkey"), F.col("s_name"), F.lit, F.to_json
    one = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    pair = lambda q, p: one(query=q, purpose=p)
    quoted = lambda *x: F.concat(lit('{"intent":"'), name, lit('",'), *x, lit("}"))
    answer = (
        F.when(key % 6 == 0, js(one(intent=name, queries=F.array(pair(F.concat(lit("q "), name), lit("p")), pair(F.concat(lit("Q  "), name), lit("again")), pair(lit("b"), lit("")), pair(lit("x 所有标签"), lit("p"))))))
        .when(key % 6 == 1, F.concat(lit("```json\n"), quoted(lit('"directions":[{"direction":"one","description":"d"},"two",{"text":"three"},7,{"query":["x"]},"4","5","6"]')), lit("\n```")))
        .when(key % 6 == 2, quoted(lit('"queries":"none","directions":["<b>a</b>","'), name, lit('"]'))).when(key % 6 == 3, quoted(lit('"queries":{"query":"only"}'))).when(key % 6 == 4, lit('{"intent":5.5e0,"queries":["a","b"]}')).otherwise("[1]")
    )
    answers = shared.written(table(spark, sf_dir, "supplier").select(key.cast("string").alias("execution"), answer.alias("answer")), "answers")
    plans, kept = questions.planned_queries(answers)
    said = F.concat(F.col("place").cast("string"), F.lit(" "), "query", F.lit(" ("), "purpose", F.lit(")"))
    held = kept.groupBy("execution").agg(F.array_join(F.sort_array(F.collect_list(said)), "|").alias("queries"))
    return plans.join(held, "execution", "left").select("execution", "error", "intent", "queries")


@query("""
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'fintech_operations' WHEN 0 THEN 'management' ELSE 'research_business' END AS audience, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'old ' || n_name WHEN 2 THEN 'x、' || n_name ELSE '' END AS focus,
       CASE n_nationkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'k1,k2,k3,k4,k5,k6,k7,k8' ELSE '' END AS tags, CASE n_nationkey % 4 WHEN 0 THEN 'year' ELSE 'month' END AS time_range, CASE n_nationkey % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'concise' ELSE 'standard' END AS report_length,
       CASE n_nationkey % 4 WHEN 0 THEN 'i: d1,d2' END AS plan FROM nation""")
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved settings of present and older form; older names and values moved, tags bounded, a plan kept if it is whole."""
    key, name, lit = F.col("n_nationkey"), F.col("n_name"), F.lit
    saved = (
        F.when(key % 4 == 0, F.concat(lit('{"config_version":2,"audience":"management","focus":"<i>'), name, lit('</i>","focus_tags":[" a ","b","a",""],"time_range":"year","report_length":"LONG","confirmed_plan":{"intent":"i","directions":["d1","","d2","d1"]}}')))
        .when(key % 4 == 1, F.concat(lit('{"question":"old '), name, lit('","analysis_perspective":"technology","analysis_depth":"short","keywords":["k1","k2","k3","k4","k5","k6","k7","k8","k9"],"report_length":"deep","time_range":"day"}')))
        .when(key % 4 == 2, F.concat(lit('{"focus_objects":["x"," ","'), name, lit('"],"audience":"nobody","confirmed_plan":{"intent":"","directions":["d"]}}'))).otherwise("broken")
    )
    out = questions.settings(table(spark, sf_dir, "nation").select("n_nationkey", saved.alias("saved")), "saved")
    plan = F.concat("plan_intent", lit(": "), F.array_join("plan_directions", ","))
    return out.select("n_nationkey", "audience", "focus", F.array_join("focus_tags", ",").alias("tags"), "time_range", "report_length", plan.alias("plan"))


@query("SELECT p_partkey, p_name AS title, p_size::VARCHAR AS size, CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE '' END AS ok, p_brand AS maker, p_partkey % 5 <> 0 AS strict FROM part WHERE p_partkey % 7 <> 0")
def front_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter whose values are JSON or not, in the looser and the stricter dialect."""
    key, lit = F.col("p_partkey"), F.lit
    title = F.regexp_extract(F.to_json(F.struct(F.concat(lit("x"), "p_name").alias("t"))), r'^\{"t":"x(.*)"\}$', 1)
    end = F.when(key % 5 == 0, "---x\n").otherwise("---\n")
    document = F.concat(
        F.when(key % 7 == 0, "\n").otherwise(""), lit('---\ntitle: "'), title, lit('"\nsize: '), F.col("p_size").cast("string"), lit("\nok: "), F.when(key % 2 == 0, "true").otherwise("null"), lit("\nmaker: '"), "p_brand", lit("'\n"), end, lit("body")
    )
    both = F.struct(text.decoded_front_matter(document).alias("m"), text.decoded_front_matter(document, strict=True).alias("s"))
    # a generator's rows are computed once, whatever reads them
    rows = shared.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand"), "p_partkey").select("p_partkey", F.inline(F.filter(F.array(both), lambda r: F.size(r["m"]) > 0)))
    get = lambda k: F.try_element_at("m", lit(k)).alias(k)
    return rows.select("p_partkey", get("title"), get("size"), get("ok"), get("maker"), (F.size("s") > 0).alias("strict"))


@query("""
WITH r AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS shown, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ' ' || c_mktsegment END AS name, c_custkey % 4 = 0 AS seed FROM customer)
SELECT count(*) FILTER (NOT seed) AS staging_count, count(*) FILTER (seed) AS seed_count, count(*) FILTER (shown = 'true') AS true_count, count(*) FILTER (shown = 'false') AS false_count,
       count(DISTINCT CASE WHEN shown = 'true' AND trim(name) <> '' THEN trim(name) END) AS visible_count FROM r""")
def seed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of staged and seed rows, of those shown and not, and of the names that are visible."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(key % 3 == 0, "true").when(key % 3 == 1, "false").otherwise("").alias("shown"), F.trim(F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))).alias("name"), (key % 4 == 0).alias("seed")
    )
    true = F.col("shown") == "true"
    return rows.agg(
        F.count_if(~F.col("seed")).alias("staging_count"), F.count_if("seed").alias("seed_count"), F.count_if(true).alias("true_count"), F.count_if(F.col("shown") == "false").alias("false_count"),
        F.count_distinct(F.when(true & (F.col("name") != ""), F.col("name"))).alias("visible_count"),
    )


@query("""
SELECT 'orders' AS dataset, 'id' AS kind, o_orderkey::VARCHAR AS value FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'orders', 'file', 'f' || o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 4 <> 0
UNION SELECT 'parts', 'id', p_partkey::VARCHAR FROM part""")
def portable_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and ids of all datasets for a later run, and none at all while one of them is empty."""
    key = F.col("o_custkey")
    file = F.when(key % 4 == 0, " ").otherwise(F.concat(F.lit("f"), key.cast("string")))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), file.alias("file"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    whole = gates.portable_baseline({"orders": (orders, ["id", "file"]), "parts": (parts, ["id"])})
    return whole.unionByName(gates.portable_baseline({"orders": (orders, ["id"]), "nothing": (parts.limit(0), ["id"])}))


@query("""
WITH c AS (SELECT c_custkey, trim(c_name) AS name, lower(trim(c_name || '@Example.COM ')) AS email, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'q' || c_custkey END AS prefix FROM customer),
d AS (SELECT c_custkey + 1000000 AS c_custkey, name, email, 'later' AS prefix FROM c WHERE c_custkey % 2 = 0), a AS (SELECT * FROM c UNION ALL SELECT * FROM d),
f AS (SELECT name, email, arg_min(prefix, c_custkey) AS prefix FROM a WHERE trim(prefix) <> '' GROUP BY ALL)
SELECT o.o_orderkey, f.prefix, n.name AS owner FROM orders AS o LEFT JOIN c AS n ON n.c_custkey = o.o_custkey LEFT JOIN f ON f.name = n.name AND f.email = n.email AND o.o_orderkey % 5 <> 0""")
def qualified_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ids in one lookup; the first qualified entry of a name and address, spaces and case aside."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.trim("c_name").alias("name"), text.email_key(F.concat("c_name", F.lit("@Example.COM "))).alias("email"), F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("q"), key.cast("string"))).alias("prefix"))
    entries = c.unionByName(c.where(key % 2 == 0).withColumns({"c_custkey": key + 1000000, "prefix": F.lit("later")})).where("trim(prefix) <> ''")
    first = keyed.pick(entries, ["name", "email"], [key], newest=False).select("name", "email", "prefix")
    names = c.select(key.alias("o_custkey"), F.col("name").alias("owner"), "email")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(names, "o_custkey", "left")
    asked = asked.withColumn("name", F.when(F.col("o_orderkey") % 5 != 0, F.col("owner")))
    return asked.join(first, ["name", "email"], "left").select("o_orderkey", "prefix", "owner")


@query("""
WITH r AS (SELECT DISTINCT CASE WHEN page_id % 11 = 0 THEN 'http://fail/' || page_id WHEN page_id % 7 = 0 THEN 'http://gone/' || page_id ELSE url || '#' || page_id END AS url, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method,
        CASE page_id % 3 WHEN 0 THEN 'now' WHEN 1 THEN 'old' END AS held FROM pages),
s AS (SELECT *, contains(url, 'fail') OR contains(url, 'gone') AS fails, method = 'GET' AND coalesce(held = 'now', FALSE) AS same FROM r)
SELECT url, method, CASE WHEN fails THEN NULL WHEN same THEN 304 ELSE 200 END AS status, CASE WHEN fails THEN NULL WHEN same THEN 'kept' ELSE method || ' ' || url END AS body, CASE WHEN NOT fails THEN substr(sha1(url), 1, 8) END AS etag,
       same AND NOT fails AS reused, CASE WHEN fails THEN 2 ELSE 1 END AS attempts, CASE WHEN contains(url, 'fail') THEN 'OSError: no connection' WHEN contains(url, 'gone') THEN 'OSError: status 404' END AS error FROM s""")
def conditional_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the cache's validators; what hasn't changed is kept, a failure is tried once more and then a row."""
    key = F.col("page_id")
    url = F.when(key % 11 == 0, F.concat(F.lit("http://fail/"), key.cast("string"))).when(key % 7 == 0, F.concat(F.lit("http://gone/"), key.cast("string"))).otherwise(F.concat("url", F.lit("#"), key.cast("string")))
    rows = table(spark, sf_dir, "pages").select(url.alias("url"), F.when(key % 5 == 0, "post").otherwise(" ").alias("method"), (key % 3).alias("k"))
    etag = F.when(F.col("k") == 0, F.substring(F.sha1("url"), 1, 8)).otherwise("stale")
    cache = rows.where("k < 2").select("url", etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit("kept").alias("body"))
    return fetch.fetched(rows.unionByName(rows), cache).drop("last_modified")


@query("""
WITH s AS (SELECT 'orders' AS name, sum(length('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') + 1)::BIGINT AS bytes FROM orders
  UNION ALL SELECT 'nations', sum(length('{"n_nationkey":' || n_nationkey || '}') + 1)::BIGINT FROM nation)
SELECT name, bytes, CASE WHEN name = 'orders' THEN 'dataset too large' END AS error FROM s""")
def package_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of a package's datasets, by the lengths of their files."""
    data = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "nations": table(spark, sf_dir, "nation").select("n_nationkey")}
    path = fresh_folder(spark, "package")
    publish.write_package(data, path)
    return publish.sizes(spark, path, most=1 << 40, member=10_000)


MARKED = ["```json\nA <b>b</b>\n```", " &lt;i&gt;x&lt;/i&gt; &amp; y ", "1 < 2 > 0", "<br/>", "", "　wide　", "x" * 200, "&quot;q&quot; ```text z"]


@query(f"""
WITH m AS (SELECT s_suppkey, {picked_sql('s_suppkey', MARKED, 1)} || s_name AS said FROM supplier),
t AS (SELECT s_suppkey, regexp_replace(regexp_replace(said, '(?i)```(?:json|markdown|html|text)?', '', 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS t FROM m),
u AS (SELECT s_suppkey, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '</?[A-Za-z][^>]*>', '', 'g') AS t FROM t)
SELECT s_suppkey, left(regexp_replace(t, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g'), 150) AS cleaned FROM u""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a model without fences, tags, entities' tags and control characters, cut to a length."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(picked("s_suppkey", MARKED, 1), "s_name").alias("said"))
    return rows.select("s_suppkey", reports.clean_text(F.col("said"), 150).alias("cleaned"))

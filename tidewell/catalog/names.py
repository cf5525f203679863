"""Names: whose a document is, and orders as Chinese readers know them; and a log of events by job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.flows import event_stream
from tidewell.catalog.labels import picked, picked_sql
from tidewell.catalog.registry import query, table
from tidewell.operators import aliases, ranking
from tidewell.plans import releases
from tidewell.sources.shared import fresh_folder
from tidewell.streaming import events

BUYERS = ["", "甲证券股份有限公司", "乙银行", "甲证券有限公司", "丙证券"]


@query(f"""
WITH a AS (SELECT 'k' || (doc_id % 40) AS name, trim(regexp_replace(substr(text, 5, 4 + (doc_id % 11)::INT), '\\s+', ' ', 'g')) AS alias FROM documents WHERE doc_id % 5 = 0),
k AS (SELECT DISTINCT name, alias FROM a WHERE alias <> ''),
d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'k' || (doc_id % 50) END AS configured, {picked_sql('doc_id', BUYERS, 1)} AS purchaser, lang, text FROM documents),
s AS (SELECT *, trim(regexp_replace(concat_ws(' ', '', purchaser, coalesce(lang, ''), substr(coalesce(text, ''), 1, 4000)), '\\s+', ' ', 'g')) AS t FROM d),
b AS (SELECT doc_id, max((length(alias), name, alias)) AS best FROM s JOIN k ON contains(t, alias) GROUP BY doc_id)
SELECT s.doc_id, coalesce(n.name, best[2], CASE WHEN contains(purchaser, '证券') THEN 'broker_' || substr(sha1(regexp_replace(purchaser, '(?:股份有限公司|有限责任公司|有限公司)$', '')), 1, 12) ELSE '' END) AS owner
FROM s LEFT JOIN b USING (doc_id) LEFT JOIN (SELECT DISTINCT name FROM k) AS n ON n.name = configured""")
def document_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose each document is, by a table of aliases that other documents give."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    some = docs.where(key % 5 == 0).select(
        F.concat(F.lit("k"), (key % 40).cast("string")).alias("name"), F.trim(F.regexp_replace(F.expr("substring(text, 5, cast(4 + doc_id % 11 as int))"), r"\s+", " ")).alias("alias")
    )
    rows = docs.select(
        "doc_id", F.when(key % 9 == 0, F.concat(F.lit("k"), (key % 50).cast("string"))).alias("configured"), F.lit("").alias("owner"), picked("doc_id", BUYERS, 1).alias("purchaser"), F.col("lang").alias("title"),
        F.col("text").alias("body"),
    )
    return aliases.identified(rows, some.where("alias <> ''"), "doc_id").withColumnRenamed("name", "owner")


NAMES = sorted({*releases.BROKERS, *releases.BROKERS.values(), "Alpha证券", "beta 证券", "10号", "阿尔法", "银行甲", "重庆证券", "长城证券", "", "证券"})
VERSIONS = ["1.0", "版本二", "版本十", "V2", "安卓版", "", "测试版", "v10"]


@query(f"""
WITH r AS (SELECT o_orderkey, o_custkey % 200 AS app, o_orderdate, {picked_sql('o_orderkey', VERSIONS, 7)} AS version FROM orders)
SELECT app, o_orderkey, version, row_number() OVER (PARTITION BY app ORDER BY o_orderdate DESC, version COLLATE zh DESC, o_orderkey) AS place FROM r QUALIFY place <= 10""")
def zh_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest first, then the version as Chinese readers order it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("app"), "o_orderdate", picked("o_orderkey", VERSIONS, 7).alias("version"))
    order = [F.desc("o_orderdate"), F.desc(ranking.zh(F.col("version"))), F.col("o_orderkey")]
    return ranking.top_per_group(rows, ["app"], order, 10, "place").select("app", "o_orderkey", "version", F.col("place").cast("long").alias("place"))


@query(f"""
WITH r AS (SELECT c_custkey, c_nationkey, {picked_sql('c_custkey', NAMES, 3)} AS name, c_acctbal FROM customer),
s AS (SELECT c_nationkey, c_custkey, name, row_number() OVER (PARTITION BY c_nationkey ORDER BY name COLLATE zh, c_custkey) AS by_name,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY name COLLATE zh DESC, c_acctbal DESC, c_custkey) AS by_name_down FROM r)
SELECT * FROM s WHERE by_name <= 20""")
def zh_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sort by name, up or down, cut to what is shown."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", picked("c_custkey", NAMES, 3).alias("name"), "c_acctbal")
    name = ranking.zh(F.col("name"))
    both = ranking.ranked(ranking.ranked(rows, ["c_nationkey"], [name, F.col("c_custkey")], "by_name"), ["c_nationkey"], [F.desc(name), F.desc("c_acctbal"), F.col("c_custkey")], "by_name_down")
    return both.where("by_name <= 20").select("c_nationkey", "c_custkey", "name", *[F.col(c).cast("long").alias(c) for c in ("by_name", "by_name_down")])


@query(f"""
WITH t AS (SELECT unnest([{picked_sql('p_partkey', NAMES, 5)}, {picked_sql('p_partkey', NAMES, 11)}]) AS tag FROM part),
c AS (SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1)
SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag COLLATE zh) AS place FROM c QUALIFY place <= 12""")
def zh_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest tags, equal counts as Chinese readers order names."""
    tags = table(spark, sf_dir, "part").select(F.explode(F.array(picked("p_partkey", NAMES, 5), picked("p_partkey", NAMES, 11))).alias("tag")).where("tag <> ''")
    top = tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), ranking.zh(F.col("tag"))).limit(12).withColumn("all", F.lit(0))  # twelve rows
    return ranking.ranked(top, ["all"], [F.desc("n"), ranking.zh(F.col("tag"))], "place").select("tag", "n", F.col("place").cast("long").alias("place"))


@query("""
WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, event_type, sequence FROM s WHERE sequence > n - 20 AND sequence > user_id % 30""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's events numbered as a stream brings them; the last twenty, after the number each reader has seen."""
    path = fresh_folder(spark, "log")
    stream = event_stream(spark, sf_dir).select("user_id", "event_id", "event_type", "ts")
    log = events.append_events(stream, f"{path}/log", f"{path}/checkpoint", "user_id", ["ts", "event_id"])
    seen = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("sequence", F.col("user_id") % 30)
    return events.replayed(log, "user_id", seen, keep=20).select("user_id", "event_id", "event_type", "sequence")

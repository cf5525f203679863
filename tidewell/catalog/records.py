"""Record keeping: best texts, key migration, side-by-side candidates, context lookups, sort modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.registry import query, table
from tidewell.operators import keyed, ranking


@query("""
WITH k AS (SELECT doc_id, source, md5(nullif(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '')) AS key, n_chars FROM documents),
b AS (SELECT source, key, max_by(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS score FROM k WHERE key IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, key) AS place FROM b)
SELECT source, key, doc_id, place FROM r WHERE place <= 5""")
def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each normalized text, told by its digest, then the five best keys of each group."""
    key = F.md5(F.nullif(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", key.alias("key"), "n_chars").where("key IS NOT NULL")
    best = rows.groupBy("source", "key").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("score"))
    top = ranking.top_per_group(best, ["source"], [F.desc("score"), F.col("key")], 5, "place")
    return top.select("source", "key", "doc_id", F.col("place").cast("long").alias("place"))


@query("""
WITH old AS (SELECT doc_id, source || '/' || n_chars AS name, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0),
new AS (SELECT doc_id, source || '/' || n_chars AS name, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 1),
n AS (SELECT name, min(doc_id) AS id FROM new GROUP BY 1 HAVING count(*) = 1), g AS (SELECT h, min(doc_id) AS id FROM new GROUP BY 1 HAVING count(*) = 1)
SELECT old.doc_id, coalesce(n.id, g.id) AS new_id, CASE WHEN n.id IS NOT NULL THEN 'name' WHEN g.id IS NOT NULL THEN 'content' ELSE 'none' END AS via
FROM old LEFT JOIN n USING (name) LEFT JOIN g USING (h)""")
def key_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old keys follow a unique name, else unique content."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "n_chars").alias("name"), F.sha2("text", 256).alias("h"))
    new = rows.where("doc_id % 3 <> 1")
    unique = lambda c, as_: new.groupBy(c).agg(F.min("doc_id").alias(as_), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = rows.where("doc_id % 3 = 0").join(unique("name", "by_name"), "name", "left").join(unique("h", "by_h"), "h", "left")
    via = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_h").isNotNull(), "content").otherwise("none")
    return out.select("doc_id", F.coalesce("by_name", "by_h").alias("new_id"), via.alias("via"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice::DECIMAL(18,2) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (k = 1) AS first_id, max(o_orderkey) FILTER (k = 2) AS second_id,
       (max(p) FILTER (k = 1) - coalesce(max(p) FILTER (k = 2), 0))::DOUBLE AS margin FROM r WHERE k <= 2 GROUP BY 1""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best candidates of each row beside each other."""
    rows = table(spark, sf_dir, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)"))
    top = ranking.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")], 2)
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    margin = at("p", 1) - F.coalesce(at("p", 2), F.lit(0))
    return top.groupBy("o_custkey").agg(at("o_orderkey", 1).alias("first_id"), at("o_orderkey", 2).alias("second_id"), margin.cast("double").alias("margin"))


@query("""
WITH c AS (SELECT d.doc_id, d.source, b.text AS own, row_number() OVER (PARTITION BY d.doc_id ORDER BY b.item_id) AS k
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 400)
SELECT doc_id, coalesce(source || ': ' || own, source) AS context FROM c WHERE k = 1""")
def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's title with the text that belongs to it, if there is anything."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 400).alias("item_id"))
    own = keyed.pick(table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], [F.col("text")], newest=False)
    rows = docs.join(own, "item_id", "left")
    return rows.select("doc_id", F.coalesce(F.concat("source", F.lit(": "), F.col("text")), F.col("source")).alias("context"))


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_totalprice > 250000) DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders""")
def amount_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an amount first, then newest."""
    order = [F.desc("large"), F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")]
    rows = ranking.ranked(table(spark, sf_dir, "orders").withColumn("large", F.col("o_totalprice") > 250000), ["o_orderstatus"], order, "place")
    return rows.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""
WITH a AS (SELECT count(*) AS n, max(o_orderdate) AS d FROM orders WHERE o_orderdate < DATE '1998-01-01'), b AS (SELECT count(*) AS n, max(o_orderdate) AS d FROM orders)
SELECT a.n < b.n AS smaller, a.d < b.d AS older, b.n - a.n AS missing FROM a, b""")
def import_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a candidate older or smaller than what there is?"""
    stats = lambda df, p: df.agg(F.count("*").alias(f"{p}_n"), F.max("o_orderdate").alias(f"{p}_d"))
    orders = table(spark, sf_dir, "orders")
    both = stats(orders.where("o_orderdate < DATE '1998-01-01'"), "a").join(stats(orders, "b"))
    return both.select((F.col("a_n") < F.col("b_n")).alias("smaller"), (F.col("a_d") < F.col("b_d")).alias("older"), (F.col("b_n") - F.col("a_n")).alias("missing"))


@query("""
WITH d AS (SELECT doc_id, source, lang, sha256(text) AS h FROM documents), bad AS (SELECT source, h FROM d GROUP BY 1, 2 HAVING bool_or(lang = 'de'))
SELECT doc_id FROM d WHERE doc_id % 2 = 1 AND (lower(source), h) NOT IN (SELECT lower(source), h FROM d WHERE doc_id % 2 = 0 AND (source, h) NOT IN (SELECT source, h FROM bad))""")
def readmitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities processed before are left out, unless one of their rows was poor."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower("source").alias("s"), "lang", F.sha2("text", 256).alias("h"))
    poor = rows.groupBy("s", "h").agg(F.bool_or(F.col("lang") == "de").alias("bad")).where("bad").select("s", "h")
    processed = rows.where("doc_id % 2 = 0").select("s", "h").distinct().join(poor, ["s", "h"], "left_anti")
    return rows.where("doc_id % 2 = 1").join(processed, ["s", "h"], "left_anti").select("doc_id")

"""Filters, windows, pages, set operations, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.registry import query, table
from tidewell.operators import facets, gates, keyed, ranking


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders WHERE o_orderdate::DATE >= (SELECT max(o_orderdate)::DATE - 90 FROM orders)")
def baseline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last 90 days of the data, not of today."""
    rows = facets.within_days_of_latest(table(spark, sf_dir, "orders"), "o_orderdate", 90)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') AND p_size BETWEEN 5 AND 25 AND p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY 1 LIMIT 5)""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all set filters together; empty ones don't count."""
    part = table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct().orderBy("p_brand").limit(5)
    cond = facets.conjunction([facets.contains_literal(["p_name"], "E"), F.col("p_size").between(5, 25), None])
    return facets.projected(part.where(cond).join(brands, "p_brand", "left_semi"), ["p_partkey", "p_name", "absent"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), '$_') OR contains(lower(source), 'src1')")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """literal search in several columns; wildcards are ordinary characters."""
    docs = table(spark, sf_dir, "documents")
    cond = facets.contains_literal(["text"], "100%") | facets.contains_literal(["text"], "$_") | facets.contains_literal(["source"], "SRC1")
    return docs.where(cond).select("doc_id")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_type), ' '), ['brass', 'economy', 'small'])")
def array_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """any of the row's tags is selected."""
    tags = F.split(F.lower("p_type"), " ")
    return table(spark, sf_dir, "part").where(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ("brass", "economy", "small")]))).select("p_partkey")


@query("""
SELECT d.source, count(*) AS n FROM documents d WHERE length(trim(text)) > 0 AND n_chars >= 200 AND lower(source) NOT IN ('src3', 'unknown', 'n/a') GROUP BY 1""")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with all that they need, placeholders left out."""
    ok = (F.length(F.trim("text")) > 0) & (F.col("n_chars") >= 200) & ~F.lower("source").isin("src3", "unknown", "n/a")
    return table(spark, sf_dir, "documents").where(ok).groupBy("source").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM p WHERE k = 1""")
def primary_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind, then newest, then id."""
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    best = ranking.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [kind, F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")], 1)
    return best.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS k FROM h)
SELECT page_id, host FROM r WHERE k <= 3 ORDER BY page_id LIMIT 15""")
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of a host at most, then fifteen of all."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return ranking.capped(rows, "host", [F.col("page_id")], 3, 15)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS place FROM conversations")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in its queue; ordered by it, queues take turns."""
    rows = ranking.interleaved(table(spark, sf_dir, "conversations"), "role", [F.col("conv_id"), F.col("turn")], "place")
    return rows.select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"))


@query("""
WITH d AS (SELECT doc_id, source || '-' || (n_chars % 50) AS id, substr(sha1(lang || chr(31) || n_chars), 1, 12) AS h FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, row_number() OVER (PARTITION BY id, h ORDER BY doc_id) AS n FROM d)
SELECT doc_id, CASE WHEN c = 1 THEN id WHEN n = 1 THEN id || '-' || h ELSE id || '-' || h || '-' || n END AS safe_id FROM c""")
def collision_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made unique by digest, then by number."""
    rows = table(spark, sf_dir, "documents").withColumn("id", F.concat("source", F.lit("-"), (F.col("n_chars") % 50).cast("string")))
    return keyed.collision_safe_ids(rows, "id", ["lang", "n_chars"], "doc_id").select("doc_id", "safe_id")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'purchase')
SELECT user_id, event_id FROM r WHERE k <= 50 UNION ALL SELECT user_id, event_id FROM events WHERE event_type = 'purchase'""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty of each owner; active rows always stay."""
    rows = ranking.retained(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 50, F.col("event_type") == "purchase")
    return rows.select("user_id", "event_id")


@query("""
WITH l AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS d, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY 1),
t AS (SELECT * FROM l ORDER BY price DESC, o_orderkey LIMIT 6)
SELECT o_custkey, o_orderkey, strftime(d, '%Y-%m-%d') AS d, row_number() OVER (ORDER BY d DESC, o_orderkey) AS place FROM t""")
def latest_top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, the six best of them, in order of time."""
    last = keyed.pick(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    top = last.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6).withColumn("all", F.lit(0))
    rows = ranking.ranked(top, ["all"], [F.desc("o_orderdate"), F.col("o_orderkey")], "place")
    return rows.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("place").cast("long").alias("place"))


@query("""
WITH t AS (SELECT count(*) AS n, greatest(1, ceil(count(*) / 20.0))::INT AS pages FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, o_custkey, least(3, pages) AS page, pages AS total_pages, n AS total
FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'P'), t WHERE r > (least(3, pages) - 1) * 20 AND r <= least(3, pages) * 20""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty, clamped to what there is."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return ranking.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20).select("o_orderkey", "o_custkey", "page", "total_pages", "total")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS kind FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey LIMIT 30""")
def case_ranked_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending rows first, then newest, the first thirty."""
    kind = F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("kind")
    return table(spark, sf_dir, "orders").orderBy(kind, F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", kind)


@query("""
SELECT o_orderkey AS id, 'order' AS kind, coalesce(o_orderstatus, 'true') AS flag FROM orders UNION ALL SELECT l_orderkey, 'line', 'true' FROM lineitem WHERE l_returnflag = 'R'""")
def union_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two kinds in one table, a missing flag by default."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind"))
    both = orders.unionByName(lines, allowMissingColumns=True)
    return both.withColumn("flag", F.coalesce(F.nullif("flag", F.lit("")), F.lit("true")))


@query("""
SELECT user_id, array_to_string(list_sort(list_filter(['view', 'click', 'purchase', 'refund'], lambda x: NOT list_contains(k, x))), ',') AS missing
FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1)""")
def except_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required values that a group lacks, in order."""
    required = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "refund")])
    present = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return present.select("user_id", F.array_join(F.sort_array(F.array_except(required, "k")), ",").alias("missing"))


@query("""
SELECT substr(sha256(lang || chr(31) || source || chr(31) || text), 1, 16) AS h, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""")
def dedupe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content digest."""
    h = F.substring(F.sha2(F.concat_ws("\x1f", "lang", "source", "text"), 256), 1, 16)
    return table(spark, sf_dir, "documents").groupBy(h.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""
WITH n AS (SELECT count(*) AS c FROM documents WHERE n_chars > 300), p AS (SELECT count(*) AS c FROM documents)
SELECT n.c AS candidate_rows, p.c AS previous_rows, n.c > 0 AND n.c >= 0.5 * p.c AS publish FROM n, p""")
def retain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish only what isn't empty and keeps half of the rows."""
    docs = table(spark, sf_dir, "documents")
    return gates.retain_gate(docs.where("n_chars > 300"), docs, 0.5)


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (doc_id IS NULL) AS null_id, count(*) FILTER (text IS NULL OR text = '') AS blank_text, count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS bad_lang,
       count(*) FILTER (n_chars <> length(text)) AS bad_size, count(*) - count(DISTINCT doc_id) AS repeated_id,
       count(*) FILTER (doc_id IS NULL) + count(*) FILTER (text IS NULL OR text = '') + count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) + count(*) FILTER (n_chars <> length(text)) + count(*) - count(DISTINCT doc_id) = 0 AS passed FROM documents""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All constraints in one pass."""
    rules = {
        "null_id": F.col("doc_id").isNull(),
        "blank_text": F.col("text").isNull() | (F.col("text") == ""),
        "bad_lang": ~F.col("lang").isin("en", "de", "fr", "es"),
        "bad_size": F.col("n_chars") != F.length("text"),
    }
    return gates.violations(table(spark, sf_dir, "documents"), rules, {"repeated_id": ["doc_id"]})


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS hour, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY 1, 2""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: hourly windows (the batch form of streaming.hourly_counts)."""
    w = F.window("ts", "1 hour")
    rows = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: sessions that end after half an hour without events."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), "n")

"""Aggregates: trends, distributions, leaderboards, coverage, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.catalog.registry import query, table
from tidewell.operators import facets, keyed, ranking

MONEY = "decimal(18,2)"


def money(column: str):
    """Exact sums: doubles as decimals before they are added."""
    return F.sum(F.col(column).cast(MONEY)).cast("double")


@query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
       count(DISTINCT CASE WHEN o_totalprice > 200000 THEN o_custkey END) AS n_large_customers
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def trend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month rows, distinct customers, distinct customers with large orders."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    large = F.when(F.col("o_totalprice") > 200000, F.col("o_custkey"))
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"), F.countDistinct(large).alias("n_large_customers")
    )


@query("""
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 12""")
def trend_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 12 months' counts."""
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    return table(spark, sf_dir, "lineitem").groupBy(month).agg(F.count("*").alias("n")).orderBy(F.desc("month")).limit(12)


@query("""
WITH c AS (SELECT p_type, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS k, count(*) OVER () AS names, sum(n) OVER () AS total FROM c)
SELECT CASE WHEN names > 8 AND k > 7 THEN 'other' ELSE p_type END AS p_type, sum(n)::BIGINT AS n, round(sum(n) * 100.0 / max(total), 1) AS percent
FROM r GROUP BY 1""")
def domain_fold_top7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders a part type, the tail beyond seven folded, percents of all."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy("p_type").agg(F.countDistinct("l_orderkey").alias("n"))
    return facets.folded_tail(counts, "p_type", "n", 8, 7, "other")


@query("""
WITH v(o_orderstatus) AS (VALUES ('F'), ('O'), ('P'), ('X'), ('other'))
SELECT v.o_orderstatus, count(s.s) AS n FROM v LEFT JOIN
  (SELECT CASE WHEN o_orderstatus IN ('F', 'O', 'P', 'X') THEN o_orderstatus ELSE 'other' END AS s FROM orders) s ON s.s = v.o_orderstatus GROUP BY 1""")
def stage_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed stages, missing ones with 0."""
    return facets.zero_filled(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"], "other")


@query("""
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers,
       count(DISTINCT CASE WHEN o_orderdate::DATE >= (SELECT max(o_orderdate)::DATE - 30 FROM orders) THEN o_custkey END) AS n_recent,
       count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS n_finished FROM orders""")
def kpi_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of conditional distinct counts, one of them relative to the latest date."""
    orders = table(spark, sf_dir, "orders")
    latest = orders.agg(F.to_date(F.max("o_orderdate")).alias("latest"))
    recent = F.when(F.to_date("o_orderdate") >= F.date_sub("latest", 30), F.col("o_custkey"))
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return orders.join(F.broadcast(latest)).agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"), F.countDistinct(recent).alias("n_recent"), F.countDistinct(done).alias("n_finished")
    )


@query("""
SELECT source, count(*) AS n_docs, round(avg((quality IS NOT NULL)::INT) * 100, 1) AS labelled_pct,
       round(avg((n_chars > 500)::INT) * 100, 1) AS long_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill rates by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rate = lambda cond: F.round(F.avg(cond.cast("int")) * 100, 1)
    return docs.groupBy("source").agg(
        F.count("*").alias("n_docs"), rate(F.col("quality").isNotNull()).alias("labelled_pct"), rate(F.col("n_chars") > 500).alias("long_pct")
    )


@query("""
WITH x AS (SELECT n_name, o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT n_name, o_orderpriority, count(*) AS c FROM x GROUP BY 1, 2),
m AS (SELECT n_name, o_orderpriority, row_number() OVER (PARTITION BY n_name ORDER BY c DESC, o_orderpriority) AS r FROM k)
SELECT x.n_name, count(DISTINCT o_orderkey) AS n_items, max(m.o_orderpriority) AS o_orderpriority, max(d) AS latest
FROM x JOIN m ON x.n_name = m.n_name AND r = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def broker_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by distinct items, with their commonest kind and latest date; top six."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("n_name", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return facets.modal_leaderboard(rows, "n_name", "o_orderkey", "o_orderpriority", "d", 6)


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT s_name, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
FROM d JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def supplier_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, supplier) pairs counted once, top six suppliers."""
    pairs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct()
    rows = pairs.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("s_name").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers")).orderBy(F.desc("n_orders"), "s_name").limit(6)


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS d FROM f WHERE r = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5""")
def price_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first priced row of each key, then the newest five."""
    first = keyed.pick(table(spark, sf_dir, "orders").where("o_totalprice > 0"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], newest=False)
    rows = first.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5)
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN n > 12 THEN 'high' WHEN n >= 8 THEN 'medium' ELSE 'low' END AS activity, count(*) AS n_customers, sum(n)::BIGINT AS n_orders FROM c GROUP BY 1""")
def activity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by how many rows they have."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    level = F.when(F.col("n") > 12, "high").when(F.col("n") >= 8, "medium").otherwise("low")
    return counts.groupBy(level.alias("activity")).agg(F.count("*").alias("n_customers"), F.sum("n").alias("n_orders"))


@query("""
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (o_orderstatus = 'F') AS n_finished,
       strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
       count(DISTINCT o_custkey::VARCHAR || '|' || o_orderpriority) AS n_pairs FROM orders""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and date span in one pass."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
        day(F.min("o_orderdate")).alias("first_date"), day(F.max("o_orderdate")).alias("last_date"),
        F.countDistinct(F.concat_ws("|", "o_custkey", "o_orderpriority")).alias("n_pairs"),
    )


@query("""
SELECT facet, value, count(*) AS n FROM
  (SELECT unnest([{'facet': 'p_brand', 'value': p_brand}, {'facet': 'p_type', 'value': p_type}, {'facet': 'p_size', 'value': p_size::VARCHAR}], recursive := true) FROM part)
WHERE trim(value) <> '' GROUP BY 1, 2""")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several facets in one pass."""
    return facets.facet_values(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("""
WITH c AS (SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1)
SELECT event_type, n, row_number() OVER (ORDER BY coalesce(list_position(['view', 'click', 'purchase'], event_type), 99), first_id) AS place FROM c""")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known types in fixed order, others as first seen."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    known = F.array_position(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), F.col("event_type"))
    counts = counts.withColumn("known", F.when(known > 0, known).otherwise(99)).withColumn("all", F.lit(0))
    return ranking.ranked(counts, ["all"], [F.col("known"), F.col("first_id")], "place").select("event_type", "n", F.col("place").cast("long").alias("place"))


@query("""
SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS tag FROM part) WHERE tag <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def tag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all rows, the commonest eight."""
    tags = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("tag")).where("tag <> ''")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(8)


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS n_views, count(DISTINCT user_id) AS n_users,
       count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS n_buyers, count(DISTINCT json_extract_string(props, '$.k')) AS n_props FROM events GROUP BY 1""")
def audit_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's counts, distinct users, and distinct values out of JSON metadata."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("n_views"), F.countDistinct("user_id").alias("n_users"),
        F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("n_buyers"),
        F.countDistinct(F.get_json_object("props", "$.k")).alias("n_props"),
    )


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1""")
def run_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts side by side."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return rows.select("o_orderpriority", *[F.col(s).cast("long").alias(f"n_{s.lower()}") for s in ("F", "O", "P")])


@query("""
WITH h AS (SELECT l_suppkey, sha256(l_orderkey::VARCHAR || chr(31) || l_linenumber::VARCHAR || chr(31) || l_returnflag) AS h FROM lineitem)
SELECT l_suppkey, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM h GROUP BY 1""")
def group_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each group that doesn't depend on the order of its rows."""
    return keyed.group_hash(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_returnflag"])


@query("""
SELECT l.source, count(*) AS attempted, count(*) FILTER (quality = 1) AS valid, count(*) FILTER (quality = 1) >= 0.8 * count(*) AND count(*) FILTER (quality = 1) > 0 AS passed,
       CASE WHEN count(*) FILTER (quality = 1) = count(*) THEN 'success' WHEN count(*) FILTER (quality = 1) > 0 THEN 'partial' ELSE 'failed' END AS status
FROM (SELECT source, quality FROM labels JOIN documents USING (doc_id)) l GROUP BY 1""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid rows a source, its gate and status."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(F.count("*").alias("attempted"), F.count_if(F.col("quality") == 1).alias("valid"))
    passed = (F.col("valid") >= 0.8 * F.col("attempted")) & (F.col("valid") > 0)
    status = F.when(F.col("valid") == F.col("attempted"), "success").when(F.col("valid") > 0, "partial").otherwise("failed")
    return counts.withColumns({"passed": passed, "status": status})


@query("""
WITH c AS (SELECT text, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n > 1) AS n_repeated, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_repeated_rows FROM c""")
def unique_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur once, and those that repeat."""
    counts = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count_if(F.col("n") == 1).alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_repeated_rows")
    )


@query("""
SELECT user_id, CASE count(DISTINCT event_type) WHEN 1 THEN min(event_type) ELSE 'all' END AS merged, count(DISTINCT event_type) AS n_kinds FROM events GROUP BY 1""")
def platform_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind stays itself, several are all."""
    kinds = F.countDistinct("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(kinds.alias("n_kinds"), F.min("event_type").alias("one")).select(
        "user_id", F.when(F.col("n_kinds") == 1, F.col("one")).otherwise("all").alias("merged"), "n_kinds"
    )


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipmode_tag, l_quantity * 2 + l_linenumber AS score FROM
  (SELECT *, l_returnflag || l_linestatus AS l_shipmode_tag FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey DESC, l_linenumber DESC) AS k FROM s)
SELECT l_orderkey, max(l_partkey) FILTER (k = 1) AS best_part, max(score) AS best_score, array_to_string(list_sort(list(DISTINCT l_shipmode_tag)), ',') AS tags,
       count(*) AS merged, array_to_string(list_slice(list(l_partkey ORDER BY score DESC, l_partkey DESC, l_linenumber DESC), 1, 5), ',') AS highlights
FROM r GROUP BY 1""")
def release_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a release: the representative by score, at most five highlights, the union of tags."""
    rows = table(spark, sf_dir, "lineitem").withColumn("tag", F.concat("l_returnflag", "l_linestatus"))
    score = F.col("l_quantity") * 2 + F.col("l_linenumber")
    order = F.struct(score.alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"))
    folds = rows.groupBy("l_orderkey").agg(
        F.max_by("l_partkey", order).alias("best_part"), F.max(score).alias("best_score"), F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"), F.count("*").alias("merged")
    )
    # five rows a key at most reach the list
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("_o")))
    best = rows.select("l_orderkey", order.alias("_o")).withColumn("_k", rank).where("_k <= 5")
    told = best.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_o"), asc=False), lambda x: x["p"].cast("string")), ",").alias("highlights"))
    return folds.join(told, "l_orderkey")


@query("""
WITH c AS (SELECT p_brand, count(*) AS n, sum(count(*)) OVER () AS total FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5)
SELECT string_agg(p_brand || ' ' || n || ' (' || floor(n * 100 / total)::BIGINT || '%)', '; ' ORDER BY n DESC, p_brand) AS said FROM c""")
def counter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest values with percents as one text."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "p_brand").limit(5).join(F.broadcast(total))
    words = F.concat(F.col("p_brand"), F.lit(" "), F.col("n").cast("string"), F.lit(" ("), F.floor(F.col("n") * 100 / F.col("total")).cast("string"), F.lit("%)"))
    row = F.struct((-F.col("n")).alias("n"), F.col("p_brand").alias("b"), words.alias("w"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["w"]), "; ").alias("said"))


@query("""
SELECT coalesce(nullif(trim(c_mktsegment), ''), c_name, 'unknown') AS label, count(*) AS n FROM customer GROUP BY 1""")
def display_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the first name that isn't blank."""
    label = F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), "c_name", F.lit("unknown"))
    return table(spark, sf_dir, "customer").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, max_by(role, turn) AS last_role, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def conversation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its ordered roles and last turn."""
    rows = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles")
    )


@query("""
SELECT bool_and(doc_id IS NOT NULL AND source <> '' AND regexp_matches(sha256(text), '^[0-9a-f]{64}$')) AS ready, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM documents""")
def skip_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is every row complete enough to be skipped next time."""
    docs = table(spark, sf_dir, "documents")
    ok = F.col("doc_id").isNotNull() & (F.col("source") != "") & F.sha2("text", 256).rlike("^[0-9a-f]{64}$")
    return docs.agg(F.bool_and(ok).alias("ready"), F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: all subtotals of two keys in one pass."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("qty"))


@query("""
SELECT n_name, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS n_lines FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join under a grouped sum; filters and columns reach the scans."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= DATE '1995-01-01'").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name").agg(money("l_extendedprice").alias("revenue"), F.count("*").alias("n_lines"))

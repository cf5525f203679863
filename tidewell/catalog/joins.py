"""Joins: ranges, candidates and links, validation, history, upserts, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog.registry import query, table
from tidewell.operators import keyed, links, ranking

day = lambda c: F.date_format(c, "yyyy-MM-dd")


def customer_orders(spark: SparkSession, sf_dir: str, status: str, prefix: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    return rows.select(*[F.col(f"o_{c}").alias(f"{prefix}_{c}") for c in ("orderkey", "custkey", "orderdate", "totalprice", "orderpriority")])


CANDIDATES = """
r AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT r.o_orderkey AS r_orderkey, n.o_orderkey AS n_orderkey, date_diff('day', n.o_orderdate::DATE, r.o_orderdate::DATE) AS gap_days,
        r.o_totalprice AS rp, n.o_totalprice AS np, r.o_orderpriority AS ro, n.o_orderpriority AS no
      FROM r JOIN n USING (o_custkey) WHERE r.o_orderdate::DATE - n.o_orderdate::DATE BETWEEN 0 AND 180)"""


@query(f"WITH {CANDIDATES} SELECT r_orderkey, n_orderkey, gap_days FROM c")
def range_join_180d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one customer with the later row at most 180 days after the earlier."""
    pairs = links.range_candidates(customer_orders(spark, sf_dir, "F", "r"), customer_orders(spark, sf_dir, "O", "n"), "r_orderdate", "n_orderdate", [("r_custkey", "n_custkey")])
    return pairs.select("r_orderkey", "n_orderkey", F.col("gap_days").cast("long").alias("gap_days"))


@query(f"""
WITH {CANDIDATES},
s AS (SELECT *, CASE WHEN ro = no THEN 1.0 ELSE 0.0 END AS same, least(rp, np) / greatest(rp, np) AS near,
        CASE WHEN gap_days <= 45 THEN 1.0 WHEN gap_days <= 120 THEN 0.75 WHEN gap_days <= 240 THEN 0.45 ELSE 0.15 END AS gap FROM c),
t AS (SELECT *, round(10000 * (0.55 * near + 0.18 * same + 0.10 + 0.07 * gap))::BIGINT AS score FROM s),
k AS (SELECT *, row_number() OVER w AS rk, lead(score, 1, 0) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY r_orderkey ORDER BY score DESC, gap_days, n_orderkey DESC))
SELECT r_orderkey, n_orderkey, score, score - nxt AS margin,
       CASE WHEN score >= 8200 AND score - nxt >= 800 THEN 'matched' WHEN score >= 8200 THEN 'conflict' WHEN score >= 6200 THEN 'review' ELSE 'unmatched' END AS verdict
FROM k WHERE rk = 1""")
def rank_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates, the best of each with its margin and verdict (scores in 1/10000)."""
    pairs = links.range_candidates(customer_orders(spark, sf_dir, "F", "r"), customer_orders(spark, sf_dir, "O", "n"), "r_orderdate", "n_orderdate", [("r_custkey", "n_custkey")])
    near = F.least("r_totalprice", "n_totalprice") / F.greatest("r_totalprice", "n_totalprice")
    same = F.when(F.col("r_orderpriority") == F.col("n_orderpriority"), 1.0).otherwise(0.0)
    total = 0.55 * near + 0.18 * same + 0.10 * links.package_similarity(F.lit(""), F.lit("")) + 0.07 * links.date_gap_score(F.col("gap_days"))
    pairs = pairs.withColumn("score", F.round(total * 10000).cast("long"))
    order = [F.desc("score"), F.col("gap_days"), F.desc("n_orderkey")]
    best = ranking.with_margin(pairs.withColumn("s", F.col("score").cast("double")), ["r_orderkey"], order, "s", 8200, 800, 6200)
    return best.select("r_orderkey", "n_orderkey", "score", F.col("margin").cast("long").alias("margin"), "verdict")


LINKS = """
l AS (SELECT l_orderkey AS result_id, l_partkey AS notice_id, CASE WHEN l_linenumber % 5 = 0 THEN 'needs_review' ELSE 'auto_matched' END AS status,
        l_returnflag = 'R' AND l_linenumber % 3 = 0 AS conflict, CASE WHEN l_linenumber % 7 = 0 THEN 'unmatched' ELSE 'matched' END AS decision,
        CASE WHEN l_linenumber % 4 = 3 THEN l_partkey + 1 ELSE l_partkey END AS candidate_id, CASE WHEN l_discount < 0.02 THEN 'n/a' ELSE (1 - l_tax)::VARCHAR END AS confidence FROM lineitem)"""


@query(f"""
WITH {LINKS},
v AS (SELECT CASE WHEN status <> 'auto_matched' THEN 'not_auto_matched' WHEN conflict THEN 'hard_conflict' WHEN decision <> 'matched' THEN 'llm_decision_mismatch'
        WHEN candidate_id <> notice_id THEN 'candidate_id_mismatch' WHEN coalesce(try_cast(confidence AS DOUBLE), 0) < 0.95 THEN 'confidence_below_threshold'
        WHEN o.o_orderkey IS NULL THEN 'missing_result_record' WHEN p.p_partkey IS NULL THEN 'missing_procurement_record' ELSE 'accepted' END AS reason
  FROM l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON result_id = o_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) p ON notice_id = p_partkey)
SELECT reason, count(*) AS n FROM v GROUP BY 1""")
def link_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each link breaks, counted."""
    line = table(spark, sf_dir, "lineitem")
    mod = lambda k: F.col("l_linenumber") % k
    rows = line.select(
        F.col("l_orderkey").alias("result_id"), F.col("l_partkey").alias("notice_id"), F.when(mod(5) == 0, "needs_review").otherwise("auto_matched").alias("status"),
        ((F.col("l_returnflag") == "R") & (mod(3) == 0)).alias("conflict"), F.when(mod(7) == 0, "unmatched").otherwise("matched").alias("decision"),
        F.when(mod(4) == 3, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("candidate_id"),
        F.when(F.col("l_discount") < 0.02, "n/a").otherwise((1 - F.col("l_tax")).cast("string")).alias("confidence"),
    )
    results = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("result_id"))
    notices = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("notice_id"))
    checked = links.validated(rows, results, notices)
    return checked.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS one, count(*) FILTER (l_returnflag = 'R') AS m, min(l_partkey) FILTER (l_returnflag = 'R') AS two FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN n = 1 THEN one WHEN m = 1 THEN two END AS l_partkey, CASE WHEN n = 1 THEN 'single' WHEN m = 1 THEN 'narrowed' ELSE 'ambiguous' END AS state FROM c""")
def ambiguous_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's only candidate, or the only one that a second test leaves."""
    return keyed.unique_partner(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", "l_partkey")


@query("""
SELECT o_orderkey, coalesce('[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) FILTER (l_linenumber IS NOT NULL) || ']', '[]') AS history,
       count(l_linenumber) AS n_results FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def nested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its lines as a JSON array in order."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").select("o_orderkey", "l_linenumber", "l_returnflag")
    # a repeated line number is ordered by its flag
    nested = links.with_history(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber"], ["l_linenumber", "l_returnflag"])
    return nested.select("o_orderkey", "history", "n_results")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def standalone_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an accepted partner."""
    taken = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(taken, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT count(*) AS n, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a partner in what was verified before."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("""
WITH a AS (SELECT * FROM documents WHERE doc_id % 2 = 0), b AS (SELECT * FROM documents WHERE doc_id % 2 = 1),
h AS (SELECT a.doc_id AS left_id, 'a_text' AS level, b.doc_id AS right_id FROM a JOIN b ON sha256(a.text) = sha256(b.text)
  UNION ALL SELECT a.doc_id, 'b_letters', b.doc_id FROM a JOIN b ON a.source || '|' || sha256(lower(regexp_replace(a.text, '[^A-Za-z]', '', 'g'))) = b.source || '|' || sha256(lower(regexp_replace(b.text, '[^A-Za-z]', '', 'g')))
  UNION ALL SELECT a.doc_id, 'c_size', b.doc_id FROM a JOIN b ON a.source || '|' || a.lang || '|' || a.n_chars = b.source || '|' || b.lang || '|' || b.n_chars),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY level, right_id) AS k FROM h)
SELECT left_id, level, right_id FROM r WHERE k = 1""")
def three_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that agree in any of three keys, by one equi-join."""
    docs = table(spark, sf_dir, "documents")
    keys = {
        "a_text": F.sha2("text", 256),
        "b_letters": F.concat_ws("|", "source", F.sha2(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), 256)),
        "c_size": F.concat_ws("|", "source", "lang", "n_chars"),
    }
    return keyed.multi_key_matches(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), keys, "doc_id", "doc_id")


@query("""
WITH o AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1),
n AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, event_id, 'live' AS origin FROM n UNION ALL SELECT user_id, event_id, 'base' FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, live rows in place of base rows."""
    events = table(spark, sf_dir, "events")
    latest = lambda kind, origin: keyed.pick(events.where(F.col("event_type") == kind), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", F.lit(origin).alias("origin"))
    return keyed.upsert(latest("view", "base"), latest("purchase", "live"), ["user_id"])


@query("""
SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each group."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("""
WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change
FROM o FULL JOIN n USING (doc_id)""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new, changed, unchanged or gone by content hash."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return keyed.changes(old, docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(text, 256).alias("h")), "doc_id", "h")


@query("""
WITH p AS (SELECT doc_id, source, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS pr FROM documents)
SELECT doc_id, source FROM p WHERE pr = (SELECT min(pr) FROM p q WHERE q.source = p.source)""")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, only rows of the best kind that it has."""
    rank = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", rank.alias("pr"))
    best = rows.groupBy("source").agg(F.min("pr").alias("pr"))
    return rows.join(best, ["source", "pr"], "left_semi").select("doc_id", "source")


@query("""
SELECT c_custkey, coalesce(a.alias, n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (VALUES ('UNITEDSTATES', 'USA'), ('UNITEDKINGDOM', 'UK'), ('NATION_3', 'three'), ('NATION_7', 'seven')) a(key, alias) ON regexp_replace(n_name, '\\s', '', 'g') = a.key""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names through a literal alias map."""
    aliases = F.create_map(*[F.lit(x) for pair in (("UNITEDSTATES", "USA"), ("UNITEDKINGDOM", "UK"), ("NATION_3", "three"), ("NATION_7", "seven")) for x in pair])
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", F.coalesce(F.try_element_at(aliases, F.regexp_replace("n_name", r"\s", "")), F.col("n_name")).alias("name"))


ALIASES = ("tion", "ent", "eau", "ción", "sch", "the", "and")


@query(f"""
WITH a AS (SELECT unnest({list(ALIASES)!r}) AS alias), d AS (SELECT doc_id, lower(substr(text, 1, 4000)) AS t FROM documents)
SELECT doc_id, max(alias) FILTER (k = 1) AS alias FROM
  (SELECT doc_id, alias, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias DESC) AS k FROM d, a WHERE contains(t, alias)) GROUP BY 1""")
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias that a text's beginning holds; a fixed dimension is an array in the row, not a join."""
    start = F.lower(F.substring("text", 1, 4000))
    hits = F.filter(F.array(*[F.lit(a) for a in ALIASES]), lambda a: F.contains(F.col("t"), a))
    ordered = F.array_sort(F.transform(hits, lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", start.alias("t")).select("doc_id", F.element_at(ordered, -1)["a"].alias("alias"), F.size(hits).alias("n"))
    return rows.where("n > 0").select("doc_id", "alias")


@query("""
WITH d AS (SELECT lower(regexp_replace(source, '\\s', '', 'g')) AS k, doc_id, lang FROM documents)
SELECT lang, count(*) AS n, count(DISTINCT k) AS n_sources FROM d WHERE k IN (SELECT k FROM d WHERE lang = 'de' GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1""")
def candidate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose normalized key is among those of another set."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower(F.regexp_replace("source", r"\s", "")).alias("k"))
    keys = rows.where("lang = 'de'").groupBy("k").agg(F.count("*").alias("c")).where("c >= 2").select("k")
    return rows.join(keys, "k", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_sources"))


@query("""
SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS orphans,
       (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS idle,
       (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lost_lines""")
def referential_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each side that the other lacks."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    orphans = orders.select("o_custkey").distinct().join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    idle = customers.select("c_custkey").distinct().join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    lost = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    one = orphans.agg(F.count("*").alias("orphans"))
    return one.join(idle.agg(F.count("*").alias("idle"))).join(lost.agg(F.count("*").alias("lost_lines")))

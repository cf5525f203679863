"""Whole flows over the synthetic tables: files written and scanned, packages, streams, linkage, research, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.catalog.registry import query, table
from tidewell.plans import linkage, research
from tidewell.sources import files, paged, payloads, publish
from tidewell.sources.shared import fresh_folder as work_folder
from tidewell.sources.shared import rename_parts, written
from tidewell.streaming import flows


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment, c_name || chr(10) || '\"quoted\", ' || c_nationkey AS note FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas, line ends and blanks come back as they were."""
    note = F.concat(F.col("c_name"), F.lit('\n"quoted", '), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), note.alias("note"))
    path = work_folder(spark, "csv")
    publish.write_csv(rows, path, rows.columns)
    return files.csv_text(spark, path, rows.columns)


@query("""
SELECT n_nationkey::VARCHAR AS id, 'title ' || n_name AS title, 'r' || n_regionkey AS folder, length('---' || chr(10) || 'title: "title ' || n_name || '"' || chr(10) || 'id: ' || n_nationkey || chr(10) || '---' || chr(10) || '# ' || n_name)::BIGINT AS n_chars FROM nation WHERE n_regionkey <> 2""")
def markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of documents with front matter; what was processed before is left out."""
    body = F.concat(F.lit('---\ntitle: "title '), "n_name", F.lit('"\nid: '), F.col("n_nationkey").cast("string"), F.lit("\n---\n# "), "n_name")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("folder"), body.alias("value"))
    path = work_folder(spark, "markdown")
    rows.repartition(25, "value").write.option("maxRecordsPerFile", 1).option("lineSep", " ").partitionBy("folder").text(path)
    rename_parts(spark, path, ".txt", ".md")  # the scan looks for .md
    docs = files.markdown_tree(spark, path).withColumn("text", F.rtrim("text")).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("folder", F.regexp_replace("folder", "^folder=", ""))
    new = files.admitted(docs, docs.where("folder = 'r2'").select("sha256"))
    return new.select(F.try_element_at("meta", F.lit("id")).alias("id"), "title", "folder", "n_chars")


@query("SELECT 'orders' AS name, count(*) AS n_rows, true AS intact FROM orders UNION ALL SELECT 'parts', count(*), true FROM part")
def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets with a manifest of counts and digests, checked on reading."""
    data = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "parts": table(spark, sf_dir, "part").select("p_partkey", "p_name")}
    path = work_folder(spark, "package")
    manifest = publish.write_package(data, path)
    bad = publish.broken_datasets(spark, path, {n: df.schema for n, df in data.items()})
    return manifest.select("name", "n_rows", (~F.col("name").isin(bad) if bad else F.lit(True)).alias("intact"))


@query("SELECT count(*) AS n_rows, 2 AS n_versions FROM orders WHERE o_orderstatus <> 'P'")
def publish_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is published if it keeps enough of the last one; a poor one leaves it standing."""
    orders, root = table(spark, sf_dir, "orders"), work_folder(spark, "published")
    publish.publish(orders, root)
    publish.publish(orders.where("o_orderstatus <> 'P'"), root)
    publish.publish(orders.where("o_orderkey < 10"), root)  # rejected
    n = len(publish.versions(spark, root))
    return publish.current(spark, root).agg(F.count("*").alias("n_rows")).withColumn("n_versions", F.lit(n))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = flows.parquet_stream(spark, sf_dir, "events.parquet", events.schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, event_type, n FROM h""")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: windowed counts as a stream that runs until its input is used up."""
    stream, path = flows.hourly_counts(event_stream(spark, sf_dir)), work_folder(spark, "hourly")
    return flows.run_complete(stream, f"{path}/rows", f"{path}/checkpoint").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats dropped within the watermark."""
    rows = event_stream(spark, sf_dir).withColumn("k", F.concat_ws("|", "user_id", "event_type")).select("k", "ts", "user_id")
    path = work_folder(spark, "seen")
    seen = flows.run_to_table(flows.first_seen(rows, "k", late="3650 days"), f"{path}/rows", f"{path}/checkpoint")
    return seen.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table kept by batches of a stream."""
    path = work_folder(spark, "upsert")
    rows = event_stream(spark, sf_dir).select("user_id", "ts", "event_id")
    return flows.upsert_into(rows, f"{path}/table", f"{path}/checkpoint", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


def _notices(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).join(table(spark, sf_dir, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat_ws(" ", F.col("o_orderpriority"), F.col("c_mktsegment"), F.lit("采购公告")).alias("title"),
        F.concat(F.lit("P-"), (F.col("o_custkey") * 7 + F.month("o_orderdate")).cast("string")).alias("number"), F.col("c_name").alias("purchaser"), F.lit("").alias("package"),
        F.to_date("o_orderdate").alias("published"), F.lit("").alias("source_file"),
    )


@query()
def linkage_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates to merged rows with a deterministic client; counts by status."""
    results, notices = _notices(spark, sf_dir, "P"), _notices(spark, sf_dir, "O")
    scored = linkage.candidates(results, notices, top=5)
    _, best = linkage.matched(scored.select("r_id", *linkage.ORDER, "conflicts"))
    best = written(best, "best")  # both passes and the decision read what was scored once
    first, second = linkage.asked(best), linkage.asked(best)
    final = written(linkage.decided(best, first, second).select("r_id", "n_id", "status"), "final")
    merged = linkage.merged(notices, results, final.where("status = 'auto_matched'"))
    return merged.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_results", F.lit(0))).alias("n_linked"))


@query("""
WITH p AS (SELECT page_id, page_id // 50 AS execution, page_id % 50 AS rank, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host,
        DATE '2024-06-01' - (page_id % 500)::INT AS published, (page_id % 50) // 2 AS pair FROM pages),
s AS (SELECT execution, pair, count(*) AS n_merged, arg_min(host, rank) AS host, arg_min(published, rank) AS published FROM p GROUP BY ALL),
f AS (SELECT *, (published >= DATE '2024-06-01' - 365)::INT AS fresh FROM s),
k AS (SELECT *, (fresh = 1 AND sum(fresh) OVER (PARTITION BY execution, host ORDER BY pair) <= 3)::INT AS kept FROM f),
l AS (SELECT *, sum(kept) OVER (PARTITION BY execution ORDER BY pair) AS place FROM k)
SELECT execution::VARCHAR AS execution, sum(n_merged)::BIGINT AS raw, count(*) AS resolved, count(*) FILTER (fresh = 0) AS stale, count(*) FILTER (fresh = 1 AND kept = 0) AS site,
       count(*) FILTER (kept = 1 AND place > 15) AS capped, count(*) FILTER (kept = 1 AND place <= 15) AS selected FROM l GROUP BY 1""")
def research_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as answers of fifty references a search, two of which are one source; read, resolved, aged out and capped, and counted in one pass."""
    page = F.col("page_id")
    reference = F.struct(
        F.concat(F.lit("p"), F.floor(page % 50 / 2).cast("string")).alias("id"), F.concat(F.lit("title "), page.cast("string")).alias("title"), "url", F.lit("").alias("website"),
        F.date_format(F.date_sub(F.lit("2024-06-01").cast("date"), (page % 500).cast("int")), "yyyy-MM-dd").alias("date"),
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct(page.alias("p"), reference.alias("r")))), lambda x: x["r"])  # fifty at most
    answers = table(spark, sf_dir, "pages").groupBy(F.floor(page / 50).cast("string").alias("execution")).agg(F.to_json(F.struct(listed.alias("references"))).alias("body"))
    # an address apart for each page: what agrees is the provider's id alone
    rows = payloads.search_references(answers, "body").withColumn("url", F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("n="), F.col("rank").cast("string")))
    return research.funnel(research.marked(research.resolved_sources(rows), "2024-06-01"))


@query("""
WITH e AS (SELECT c_custkey, c_custkey % 5 AS planned, c_custkey % 3 AS more, c_custkey % 7 = 3 AS fails FROM customer),
asked AS (
  SELECT c_custkey, 0 AS round, unnest(range(planned)) AS q, fails FROM e
  UNION ALL SELECT c_custkey, r AS round, planned + r - 1 AS q, fails FROM e, (SELECT unnest(range(1, 4)) AS r) WHERE r <= more AND planned + r - 1 < 3 AND NOT (fails AND planned + r - 1 > 0))
SELECT c_custkey::VARCHAR AS execution, round::INT AS round, count(*) AS queries, count(*) FILTER (NOT (fails AND q = 0)) AS answers, count(*) FILTER (NOT (fails AND q = 0)) AS addresses, count(*) FILTER (fails AND q = 0) AS failures
FROM asked GROUP BY ALL""")
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned queries of many executions at once, then supplemental ones only where sources are too few; a failure ends an execution."""
    key = F.col("c_custkey")
    queries = lambda first, n: F.transform(F.slice(F.array(*[F.lit(i) for i in range(8)]), 1, n.cast("int")), lambda i: F.concat(key.cast("string"), F.lit("/"), (i + first).cast("string")))
    executions = table(spark, sf_dir, "customer").select(key.cast("string").alias("execution"), queries(F.lit(0), key % 5).alias("planned"), queries(key % 5, key % 3).alias("supplemental"))
    fails = (F.col("execution").cast("long") % 7 == 3) & F.col("query").endswith("/0")
    ask = lambda df: df.select("*", F.lit(1).alias("rank"), F.when(~fails, F.col("query")).alias("url"), F.when(fails, "refused").alias("error"))
    return research.searched(executions, ask, 3, work_folder(spark, "rounds"))[1]


@query("""
WITH i AS (SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, datediff('month', o_orderdate::DATE, max(o_orderdate) OVER ()::DATE)::INT AS page FROM orders)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY date DESC, id) - 1)::INT AS place, id, date FROM i QUALIFY date >= '1998-05-15' AND id NOT IN ('1', '2', '3', '33')""")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders as pages of a list, newest first, read by a client; the scan ends where items are older than asked for, and known ids aren't followed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.to_date("o_orderdate").alias("day"))
    last = orders.agg(F.max("day").alias("last"))
    months = F.year("last") * 12 + F.month("last") - F.year("day") * 12 - F.month("day")
    pages = orders.crossJoin(F.broadcast(last)).select(months.alias("page"), "id", F.date_format("day", "yyyy-MM-dd").alias("date"))  # one row
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("date"), "id")) - 1
    path = work_folder(spark, "pages")
    pages.withColumn("place", place).write.partitionBy("page").json(path)
    paged.register(spark)
    n = pages.agg(F.max("page")).first()[0]
    options = {"path": path, "pages": str(n + 1), "order": "newest"}
    items = spark.read.format(paged.PagedSource.name()).options(**options).load()
    known = ("1", "2", "3", "33")
    return items.where((F.col("date") >= "1998-05-15") & ~F.col("id").isin(*known)).select("page", "place", "id", "date")


@query("""
SELECT 'b' || n_nationkey AS owner, n_name || ' ' || g AS title FROM nation, (VALUES (1), (2)) AS t(g) WHERE n_nationkey % 6 < 4 AND g = CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END""")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each owner the documents of the generation that its manifest names, if that passed its gate; an owner with a broken manifest has none."""
    root, key = work_folder(spark, "official"), F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("b"), key.cast("string")).alias("owner"), key.alias("k"), "n_name")
    bodies = nations.select("owner", F.explode(F.array(F.lit(1), F.lit(2))).alias("g"), "n_name").select("owner", F.concat(F.lit("gen-"), F.col("g").cast("string")).alias("gen"), F.concat(F.lit("# "), "n_name", F.lit(" "), F.col("g").cast("string")).alias("value"))
    bodies.write.partitionBy("owner", "gen").text(f"{root}/docs")
    state = F.when(F.col("k") % 6 == 4, "{broken").otherwise(F.to_json(F.struct((F.col("k") % 6 != 5).alias("quality_passed"), F.when(F.col("k") % 2 == 0, "gen-2").otherwise("gen-1").alias("output"))))
    nations.select("owner", state.alias("value")).write.partitionBy("owner").text(f"{root}/manifests")
    rename_parts(spark, f"{root}/docs", ".txt", ".md")
    rename_parts(spark, f"{root}/manifests", ".txt", ".json")
    docs = files.latest_documents(spark, f"{root}/manifests/owner=*/*.json", lambda owner, output: f"{root}/docs/owner={owner}/gen={output}")
    return docs.select("owner", "title")

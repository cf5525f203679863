"""Search sources: resolved to one row each, aged out, capped by site, with the funnel's counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewell.functions import values
from tidewell.sources.shared import tasks

RESOLVED = "execution string, source_id int, rank int, provider_id string, url string, title string, site string, published date, n_merged int"


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows in order of rank join the first source that shares a provider id, else an address, else a title; blanks are filled."""
    sources: list[dict] = []
    index: dict[tuple[str, str], int] = {}
    for row in pdf.sort_values(["rank", "provider_id"]).to_dict("records"):
        keys = [(k, row[c]) for k, c in (("id", "provider_id"), ("url", "key_url"), ("title", "key_title")) if isinstance(row[c], str) and row[c]]
        at = next((index[k] for k in keys if k in index), None)
        if at is None:
            at = len(sources)
            sources.append({**row, "source_id": at, "n_merged": 0})
        own = sources[at]
        own["n_merged"] += 1
        for c in ("provider_id", "url", "title", "site", "published"):
            if own[c] is None or own[c] == "" or own[c] is pd.NaT:
                own[c] = row[c]
        for k in keys:
            index.setdefault(k, at)
    return pd.DataFrame(sources)[[c.split()[0] for c in RESOLVED.split(", ")]]


def resolved_sources(rows: DataFrame) -> DataFrame:
    """rows (execution, rank, provider_id, url, title, site, published) -> one row for each source.

    The order of joining matters, so an execution's rows (some dozens) are folded in one group.
    """
    keyed = rows.withColumns({
        "key_url": values.canonical_url(F.col("url")), "key_title": F.lower(F.regexp_replace("title", r"[\s\p{Punct}，。、；：？！]+", "")),
    })
    return keyed.groupBy("execution").applyInPandas(_resolve, RESOLVED)


STATUS = ("stale", "site", "capped", "selected")


def marked(sources: DataFrame, now: str, max_age_days: int = 365, per_site: int = 3, total: int = 15) -> DataFrame:
    """sources with status: stale if dated and too old; site beyond per_site fresh ones of a host; capped beyond total of an execution; else selected, with place."""
    fresh = F.col("published").isNull() | (F.col("published") >= F.date_sub(F.lit(now).cast("date"), max_age_days))
    rows = sources.withColumns({"host": values.host(F.col("url")), "_fresh": fresh.cast("int")})
    order = lambda *by: Window.partitionBy(*by).orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_kept", ((F.col("_fresh") == 1) & (F.sum("_fresh").over(order("execution", "host")) <= per_site)).cast("int"))
    rows = rows.withColumn("place", F.sum("_kept").over(order("execution")))
    status = F.when(F.col("_fresh") == 0, "stale").when(F.col("_kept") == 0, "site").when(F.col("place") > total, "capped").otherwise("selected")
    return rows.withColumn("status", status).withColumn("place", F.when(F.col("status") == "selected", F.col("place"))).drop("_fresh", "_kept")


def selected(sources: DataFrame, now: str, max_age_days: int = 365, per_site: int = 3, total: int = 15) -> DataFrame:
    """Fresh or undated sources, per_site of a host and total of an execution at most, in order."""
    return marked(sources, now, max_age_days, per_site, total).where("status = 'selected'").drop("status")


def funnel_counts() -> list[Column]:
    """Of marked rows: raw answers, resolved sources, and sources by status."""
    return [F.coalesce(F.sum("n_merged"), F.lit(0)).alias("raw"), F.count("*").alias("resolved"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUS]]


def funnel(rows: DataFrame) -> DataFrame:
    """execution, raw, resolved, stale, site, capped, selected of marked rows: one aggregation."""
    return rows.groupBy("execution").agg(*funnel_counts())


def write_sources(rows: DataFrame, path: str) -> dict[str, int]:
    """Write marked rows' selected ones below path; the whole funnel's counts are observed in the pass that writes them."""
    seen = Observation()
    rows.observe(seen, *funnel_counts()).where("status = 'selected'").write.parquet(path)
    return seen.get


def grounded(items: DataFrame, known: DataFrame) -> DataFrame:
    """items (item_id, kind, source_ids) with only known sources; facts and analyses left without one are dropped."""
    pairs = items.select("item_id", F.explode("source_ids").alias("source_id")).join(known.select("source_id"), "source_id", "left_semi")
    kept = pairs.groupBy("item_id").agg(F.sort_array(F.collect_set("source_id")).alias("_ids"))
    out = items.join(kept, "item_id", "left").withColumn("source_ids", F.coalesce("_ids", F.array().cast("array<string>"))).drop("_ids")
    return out.where((F.col("kind") == "recommendation") | (F.size("source_ids") > 0))


def searched(executions: DataFrame, ask: Callable[[DataFrame], DataFrame], minimum: int, root: str, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(answers of all rounds, counters by execution and round) of executions (execution, planned, supplemental: arrays of queries).

    Round 0 asks all planned queries; each later round asks the next supplemental one of executions that have fewer than
    ``minimum`` different addresses and no failure so far. ``ask`` takes (execution, query) and gives (execution, query,
    rank, url, error), a failure being one row with an error. Rounds are written below root, and read again by the next.
    An execution's rows stay in one of n tasks, whose number grows with the executions, so that a task's memory doesn't.
    """
    n = tasks(executions, 50_000)
    executions = executions.repartition(n, "execution")
    spark, schema = executions.sparkSession, "execution string, query string, rank int, url string, error string, round int"
    for i in range(rounds + 1):
        if i == 0:
            todo = executions.select("execution", F.explode("planned").alias("query"))
        else:
            so_far = spark.read.schema(schema).parquet(f"{root}/round-*").repartition(n, "execution").groupBy("execution").agg(F.count_distinct("url").alias("_n"), F.count("error").alias("_e"))
            low = executions.join(so_far, "execution", "left").where((F.coalesce("_n", F.lit(0)) < minimum) & (F.coalesce("_e", F.lit(0)) == 0))
            todo = low.select("execution", F.get("supplemental", F.lit(i - 1)).alias("query")).where("query IS NOT NULL")
        answers = ask(todo).select("execution", "query", F.col("rank").cast("int").alias("rank"), "url", "error", F.lit(i).alias("round"))
        answers.write.parquet(f"{root}/round-{i}")
    out = spark.read.schema(schema).parquet(f"{root}/round-*")
    # sets of one execution's round; several count_distinct would deal all rows anew, each of them several times
    counters = out.repartition(n, "execution").groupBy("execution", "round").agg(F.size(F.collect_set("query")).cast("long").alias("queries"), F.count("url").alias("answers"), F.size(F.collect_set("url")).cast("long").alias("addresses"), F.count("error").alias("failures"))
    return out, counters

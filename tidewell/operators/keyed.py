"""Keyed operators: latest and first rows, upserts, change detection, hashes of groups.

All work by grouping or by equi-joins on their keys. Where one row of a group is
kept, it is picked by an aggregate (max_by / min_by) rather than by a window, so
that each task sends one row a key at most and a hot key stays small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column], newest: bool = True) -> DataFrame:
    """One row of each key: the greatest (or least) by order. Ties must be broken by order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    by = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    chosen = (F.max_by if newest else F.min_by)(row, by)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(chosen.alias("_row")).select("_row.*")


def upsert(base: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """base with live's rows in place of rows of the same key, and live's new keys."""
    return base.join(live.select(*keys).distinct(), keys, "left_anti").unionByName(live)


def replace_groups(base: DataFrame, fresh: DataFrame, key: str, processed: DataFrame) -> DataFrame:
    """base without the keys that were processed again, and what processing gave (maybe nothing)."""
    return base.join(processed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (new, changed, unchanged, gone); an old digest that is blank counts as changed."""
    both = old.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_was")).join(
        new.select(F.col(key), F.col(digest).alias("_new"), F.lit(True).alias("_is")), key, "full"
    )
    kind = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "gone")
        .when((F.coalesce("_old", F.lit("")) != "") & (F.col("_old") == F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return both.select(key, kind.alias("change"))


def group_hash(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, digest: of each group's row digests in order, so that the order of rows doesn't matter. A group's digests meet in one row; see group_digest for large groups."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"))


def group_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, digest: number of each group's rows and sums of two halves of their digests: any order of rows gives it, and a group of any size needs no list."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    half = lambda i: F.sum(F.conv(F.substring("_row", i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    rows = df.select(*keys, row.alias("_row"))
    return rows.groupBy(*keys).agg(F.concat_ws("-", F.count("*").cast("string"), half(1), half(16)).alias("digest"))


def with_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with n_same: rows of the same key, by a grouped count joined back."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_same"))
    return df.join(counts, keys)


def multi_key_matches(left: DataFrame, right: DataFrame, keys: dict[str, Column], left_id: str, right_id: str) -> DataFrame:
    """left_id, level, right_id: for rows of left that agree with right in any of several keys.

    An OR over equalities would be a nested loop; here each key becomes a row
    (level, value) of both sides, and one equi-join serves all. The level is the
    alphabetically first one that matches, then the smallest right_id.
    """
    def spread(df: DataFrame, key: str, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(level).alias("level"), value.cast("string").alias("value")) for level, value in keys.items()])
        rows = df.select(F.col(key).alias(name), F.explode(pairs).alias("p")).select(name, "p.level", "p.value")
        return rows.where("value IS NOT NULL AND value <> ''")

    hits = spread(left, left_id, "left_id").join(spread(right, right_id, "right_id"), ["level", "value"])
    best = hits.groupBy("left_id").agg(F.min(F.struct("level", "right_id")).alias("m"))
    return best.select("left_id", "m.level", "m.right_id")


def unique_partner(candidates: DataFrame, key: str, narrow: Column, partner: str) -> DataFrame:
    """key, partner, state: the only candidate of a key, else the only one that narrow accepts, else ambiguous."""
    found = candidates.groupBy(key).agg(
        F.count("*").alias("n"), F.min(partner).alias("one"), F.count(F.when(narrow, 1)).alias("m"), F.min(F.when(narrow, F.col(partner))).alias("two")
    )
    state = F.when(F.col("n") == 1, "single").when(F.col("m") == 1, "narrowed").otherwise("ambiguous")
    return found.select(key, F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("two")).alias(partner), state.alias("state"))


def collision_safe_ids(df: DataFrame, id_col: str, content: list[str], tie: str) -> DataFrame:
    """df with safe_id: ids that occur once stay; others get their row's digest, and equal rows a number."""
    digest = F.substring(F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])), 1, 12)
    rows = with_uniqueness(df.withColumn("_d", digest), [id_col])
    nth = F.row_number().over(Window.partitionBy(id_col, "_d").orderBy(tie))
    suffix = F.concat(F.lit("-"), F.col("_d"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(F.lit("")))
    rows = rows.withColumn("_n", nth)
    safe = F.when(F.col("n_same") == 1, F.col(id_col).cast("string")).otherwise(F.concat(F.col(id_col).cast("string"), suffix))
    return rows.withColumn("safe_id", safe).drop("_d", "_n", "n_same")


def stale_recovered(rows: DataFrame, now: Column) -> DataFrame:
    """Executions (status, search_status, analysis_status, completed_at) that a stopped process left open, marked as failed.

    Those whose search was done failed in analysis; the others in search. What is completed already keeps its time.
    """
    is_open = F.col("status").isin("pending", "running")
    searched = F.coalesce(F.col("search_status") == "succeeded", F.lit(False))
    return rows.withColumns({
        "completed_at": F.when(is_open, F.coalesce("completed_at", now)).otherwise(F.col("completed_at")),
        "analysis_status": F.when(is_open & searched, "failed").when(is_open, "not_run").otherwise(F.col("analysis_status")),
        "search_status": F.when(is_open & ~searched, "failed").otherwise(F.col("search_status")), "status": F.when(is_open, "failed").otherwise(F.col("status")),
    })


def answered(inputs: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], DataFrame], again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(inputs with answer and error, the cache as it is afterwards) by a cache of (key, answer), answers being JSON.

    ``ask`` gives (key, answer, error) for the inputs without a readable answer (for all of them if ``again``); keys are
    unique. A question that failed leaves what the cache held, so a failed retry destroys nothing.
    """
    readable = cache.where(F.get_json_object("answer", "$").isNotNull()).select("key", "answer")
    asked = ask(inputs if again else inputs.join(readable.select("key"), "key", "left_anti")).select("key", F.col("answer").alias("_new"), "error")
    kept = cache.select("key", "answer").join(asked.where("error IS NULL").select("key", "_new"), "key", "full_outer")
    after = kept.select("key", F.coalesce("_new", "answer").alias("answer"))
    held = readable.withColumnRenamed("answer", "_held")
    out = inputs.join(held, "key", "left").join(asked, "key", "left")
    answer = F.coalesce(F.when(F.col("error").isNull(), F.col("_new")), F.col("_held"))
    return out.withColumn("answer", answer).drop("_held", "_new"), after

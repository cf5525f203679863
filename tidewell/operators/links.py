"""Record linkage: range-restricted candidates, similarity, decisions, validation.

A candidate is a pair (result, notice) whose notice date lies 0 to ``days`` days
before the result's. Dates become buckets of ``days`` days; a result looks at its own
bucket and the one before, so the range join is an equi-join on the bucket
and further keys, with the exact range as its filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_DAYS = 180


def range_candidates(results: DataFrame, notices: DataFrame, result_date: str, notice_date: str, on: list[tuple[str, str]], days: int = WINDOW_DAYS) -> DataFrame:
    """Pairs equal in all of ``on`` with 0 <= result - notice <= days; undated rows give none.

    ``on`` narrows the pairs of a bucket; with none, a bucket is all that narrows them.
    """
    day = lambda c: F.unix_date(F.to_date(c))
    left = results.withColumn("_d", day(result_date)).where("_d IS NOT NULL")
    left = left.withColumn("_b", F.explode(F.array(F.floor(F.col("_d") / days), F.floor(F.col("_d") / days) - 1)))
    right = notices.withColumn("_e", day(notice_date)).where("_e IS NOT NULL").withColumn("_c", F.floor(F.col("_e") / days))
    cond = (F.col("_b") == F.col("_c")) & (F.col("_d") - F.col("_e")).between(0, days)
    for a, b in on:
        cond = cond & (F.col(a) == F.col(b))
    return left.join(right, cond).withColumn("gap_days", F.col("_d") - F.col("_e")).drop("_b", "_c", "_d", "_e")


def date_gap_score(gap: Column) -> Column:
    """0.5 if unknown, 0 before, then by how many days lie between."""
    return (
        F.when(gap.isNull(), 0.5).when(gap < 0, 0.0).when(gap <= 45, 1.0).when(gap <= 120, 0.75).when(gap <= 240, 0.45).otherwise(0.15)
    )


def package_similarity(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.6).otherwise(0.0)


def pair_score(title: Column, purchaser: Column, package: Column, number: Column, date: Column) -> Column:
    """Weighted sum of similarities, with a bonus for equal numbers, at most 1, to 4 places half-even."""
    total = 0.55 * title + 0.18 * purchaser + 0.10 * package + 0.10 * number + 0.07 * date
    total = F.when(number == 1.0, F.least(F.lit(1.0), total + 0.08)).otherwise(total)
    return F.bround(total, 4)


def hard_conflicts(number_differs: Column, package_differs: Column, date_before: Column, second_round: Column) -> Column:
    """Names of the rules that speak against a link, in fixed order."""
    rules = (("project_number", number_differs), ("package", package_differs), ("date_order", date_before), ("second_round", second_round))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def two_pass_decision(first: Column, second: Column, same: Column, confidence: Column, conflict: Column, error: Column) -> Column:
    """Both passes must agree before a link or its absence is accepted."""
    return (
        F.when(error, "failed")
        .when((first == "matched") & (second == "matched") & same & (confidence >= 0.95) & ~conflict, "auto_matched")
        .when((first == "unmatched") & (second == "unmatched") & (confidence >= 0.90), "auto_unmatched")
        .otherwise("needs_review")
    )


def validated(links: DataFrame, results: DataFrame, notices: DataFrame, least: float = 0.95) -> DataFrame:
    """links (result_id, notice_id, status, conflict, decision, candidate_id, confidence) with reason: the first rule broken, or null.

    results and notices are tables of ids; a missing record is a reason, not a lost row.
    """
    rows = links.join(results.select(F.col("result_id").alias("_r")).distinct(), F.col("result_id") == F.col("_r"), "left")
    rows = rows.join(notices.select(F.col("notice_id").alias("_n")).distinct(), F.col("notice_id") == F.col("_n"), "left")
    confidence = F.expr("try_cast(confidence AS double)")
    reason = (
        F.when(F.col("result_id").isNull() | F.col("notice_id").isNull(), "invalid_input")
        .when(F.col("status") != "auto_matched", "not_auto_matched")
        .when(F.col("conflict"), "hard_conflict")
        .when(F.col("decision") != "matched", "llm_decision_mismatch")
        .when(F.col("candidate_id") != F.col("notice_id"), "candidate_id_mismatch")
        .when(F.coalesce(confidence, F.lit(0.0)) < least, "confidence_below_threshold")
        .when(F.col("_r").isNull(), "missing_result_record")
        .when(F.col("_n").isNull(), "missing_procurement_record")
    )
    return rows.withColumn("reason", reason).drop("_r", "_n")


def with_history(notices: DataFrame, results: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """notices with history (JSON array of its results' fields, in order) and n_results."""
    row = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in fields]).alias("_body"))
    nested = results.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.count("*").alias("_n"))
    nested = nested.select("_key", F.to_json(F.transform("_rows", lambda x: x["_body"])).alias("_json"), "_n")
    out = notices.join(nested, F.col(key) == F.col("_key"), "left")
    return out.withColumns({"history": F.coalesce("_json", F.lit("[]")), "n_results": F.coalesce("_n", F.lit(0)).cast("long")}).drop("_key", "_json", "_n")


def resolved_selectors(selectors: list[str], names: DataFrame) -> DataFrame:
    """selector, status, name: each selector by alias (exact, letter case aside), else by the only name that begins so.

    names has name and alias, as many rows as aliases; the selectors are few and the user's. Where several
    names begin so the status is ambiguous, where none does it is unknown, and name is null in both. Of an alias
    that several names share, the least name counts; blank selectors are left out.
    """
    spark = names.sparkSession
    asked = [(s, s.strip().lower()) for s in dict.fromkeys(selectors) if s.strip()]
    asked = F.broadcast(spark.createDataFrame(asked, "selector string, key string"))
    exact = names.join(asked, F.lower("alias") == F.col("key")).groupBy("selector").agg(F.min("name").alias("exact"))
    begun = names.join(asked, F.startswith(F.lower("alias"), F.col("key"))).groupBy("selector").agg(F.countDistinct("name").alias("n"), F.min("name").alias("first"))
    rows = asked.select("selector").join(exact, "selector", "left").join(begun, "selector", "left")
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return rows.select("selector", status.alias("status"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("first"))).alias("name"))

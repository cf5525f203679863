"""Data-quality gates: what must hold before a result is published, as single passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """n_rows, how many rows break each rule or repeat each unique key, and passed (none does)."""
    counts = [F.count("*").alias("n_rows"), *[F.count_if(c).alias(n) for n, c in rules.items()]]
    counts += [(F.count("*") - F.countDistinct(*[F.col(k) for k in keys])).alias(n) for n, keys in (unique or {}).items()]
    out = df.agg(*counts)
    names = [*rules, *(unique or {})]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0])) if names else F.lit(0)
    return out.withColumn("passed", total == 0)


def retain_gate(candidate: DataFrame, previous: DataFrame, ratio: float) -> DataFrame:
    """candidate_rows, previous_rows, publish: not empty, and at least ratio of what there was."""
    counts = candidate.agg(F.count("*").alias("candidate_rows")).join(previous.agg(F.count("*").alias("previous_rows")))
    return counts.withColumn("publish", (F.col("candidate_rows") > 0) & (F.col("candidate_rows") >= ratio * F.col("previous_rows")))


def failure_gate(failed: int, attempted: int, limit: float = 0.5) -> bool:
    """True lets a run through; a share of failures at the limit or above blocks it."""
    return attempted > 0 and failed / attempted < limit


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do both hold the same rows, repeats counted?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def may_publish(candidate: DataFrame, previous: DataFrame, ratio: float = 0.5) -> bool:
    return bool(retain_gate(candidate, previous, ratio).first()["publish"])


def portable_baseline(datasets: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """dataset, kind, value: the different values of each dataset's columns (kinds), sorted within each; no row at all if a dataset is empty.

    Blank values don't count. What a later run compares with is a table, so sets of any size stay distributed.
    """
    parts, sizes = [], []
    for name, (df, columns) in datasets.items():
        sizes.append(df.limit(1).select(F.lit(name).alias("_there")))
        for c in columns:
            value = F.trim(F.col(c).cast("string"))
            parts.append(df.select(F.lit(name).alias("dataset"), F.lit(c).alias("kind"), value.alias("value")).where(value != "").distinct())
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    complete = union(sizes).agg((F.count("*") == len(datasets)).alias("_complete"))  # one row
    return union(parts).crossJoin(F.broadcast(complete)).where("_complete").drop("_complete").sort("dataset", "kind", "value")

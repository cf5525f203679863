"""Ranking within groups, caps, interleaving, retention, pages.

Windows are partitioned by the group; where rows are capped, the rank filter
stands right above the window, so that Spark keeps only the first rows of each
group before it shuffles them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zh(c: Column) -> Column:
    """A name to order by as Chinese readers do (by the sound of its characters, before Latin letters)."""
    return F.collate(c, "zh")


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return ranked(df, groups, order, name).where(F.col(name) <= n)


def with_margin(df: DataFrame, groups: list[str], order: list[Column], score: str, matched: float = 0.82, clear: float = 0.08, review: float = 0.62) -> DataFrame:
    """The best row of each group with its margin to the runner-up and a verdict.

    The score is taken as rounded to 4 places, so that thresholds compare what is shown.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    rows = df.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score, 1, 0.0).over(w)}).where("_r = 1")
    margin = F.round(F.col(score) - F.col("_next"), 4)
    verdict = (
        F.when((F.col(score) >= matched) & (margin >= clear), "matched").when(F.col(score) >= matched, "conflict").when(F.col(score) >= review, "review").otherwise("unmatched")
    )
    return rows.withColumns({"margin": margin, "verdict": verdict}).drop("_r", "_next")


def capped(df: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """per_group rows of each group at most, then total rows, in order; the cap of groups comes first.

    The last step is a top-k, which tasks do on their own rows before the rest meets.
    """
    return top_per_group(df, [group], order, per_group, "_r").drop("_r").orderBy(*order).limit(total)


def interleaved(df: DataFrame, queue: str, order: list[Column], name: str = "turn") -> DataFrame:
    """df with each row's place in its queue: ordered by it, then by queue, the queues take turns."""
    return ranked(df, [queue], order, name)


def retained(df: DataFrame, owner: str, order: list[Column], keep: int, active: Column) -> DataFrame:
    """The first ``keep`` rows of each owner, counting only inactive ones; active rows always stay."""
    idle = df.where(~active)
    return df.where(active).unionByName(top_per_group(idle, [owner], order, keep, "_r").drop("_r"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with its meta columns; numbers beyond the last page give the last one."""
    total = df.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"page": F.lit(number), "total_pages": F.lit(pages), "total": F.lit(total).cast("long")})

"""Dashboard filters and aggregates: facets, time ranges relative to the data, folded tails, zero filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_days_of_latest(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days that end at the latest date in df, both ends included; undated rows go.

    The latest date is one value, found by a partial maximum in each task.
    """
    latest = df.select(F.to_date(F.max(date)).alias("_latest"))
    return df.join(F.broadcast(latest), F.to_date(date).between(F.date_sub("_latest", days), F.col("_latest"))).drop("_latest")


def conjunction(filters: list[Column | None]) -> Column:
    """All filters that are set; None stands for no filter."""
    return reduce(lambda a, b: a & b, [f for f in filters if f is not None], F.lit(True))


def contains_literal(columns: list[str], needle: str) -> Column:
    """Any of the columns contains needle, letter case aside; % and _ are ordinary characters."""
    low = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), low) for c in columns])


def projected(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the order of names."""
    return df.select(*[c for c in names if c in df.columns])


def facet_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: values that occur in each column, blank ones left out.

    One pass: each row gives a (facet, value) pair a column, counted in tasks before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL AND trim(value) <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def self_excluding(df: DataFrame, column: str, others: Column, selected: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, options) of a facet with several choices.

    Options are the column's values, with their counts, under all other filters but not its own;
    of what is selected, values that are no option any more don't count; rows are those under the other
    filters and, if some selection is left, with one of the selected values. Blank values are no options.
    """
    under = df.where(others)
    options = under.where(F.trim(F.col(column)) != "").groupBy(column).agg(F.count("*").alias("n"))
    options = options.withColumn("selected", F.col(column).isin(selected) if selected else F.lit(False))
    # as many rows as values selected, at most
    left = [r[0] for r in options.where("selected").select(column).collect()]
    return (under.where(F.col(column).isin(left)) if left else under), options


def folded_tail(counts: DataFrame, name: str, n: str, most: int, keep: int, other: str) -> DataFrame:
    """name, n, percent: if there are over ``most`` names, the ``keep`` largest and the rest as one.

    counts has one row a name; percents are of all, one decimal place.
    """
    top = F.broadcast(counts.orderBy(F.desc(n), name).limit(keep).select(F.col(name).alias("_top")))
    totals = F.broadcast(counts.agg(F.count("*").alias("_names"), F.sum(n).alias("_all")))  # one row
    rows = counts.crossJoin(totals).join(top, F.col(name).eqNullSafe(F.col("_top")), "left")
    shown = F.when((F.col("_names") > most) & F.col("_top").isNull(), F.lit(other)).otherwise(F.col(name))
    out = rows.groupBy(shown.alias(name)).agg(F.sum(n).alias(n), F.max("_all").alias("_all"))
    return out.select(name, n, F.round(F.col(n) * 100.0 / F.col("_all"), 1).alias("percent"))


def zero_filled(df: DataFrame, column: str, values: list[str], other: str) -> DataFrame:
    """column, n for each of the values, 0 where none occurs; what isn't among them counts as other."""
    value = F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.lit(other))
    counts = df.groupBy(value.alias(column)).agg(F.count("*").alias("n"))
    all_values = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys([*values, other])], f"{column} string")
    return all_values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def modal_leaderboard(df: DataFrame, name: str, item: str, kind: str, date: str, top: int) -> DataFrame:
    """name, n_items (distinct), kind (the commonest; ties: first by order), latest: the ``top`` by n_items."""
    by_kind = df.groupBy(name, kind).agg(F.count("*").alias("_c"))
    modal = by_kind.groupBy(name).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(kind).alias("k"))).alias("_m")).select(F.col(name).alias("_name"), F.col("_m.k").alias(kind))
    totals = df.groupBy(name).agg(F.countDistinct(item).alias("n_items"), F.max(date).alias("latest"))
    out = totals.join(modal, F.col(name) == F.col("_name")).drop("_name")
    return out.orderBy(F.desc("n_items"), name).limit(top)

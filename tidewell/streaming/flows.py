"""Structured Streaming: windows with late data, sessions, repeats dropped, upserts, running until the input is used up.

The reference works in batches only; these are its increments as streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import keyed
from tidewell.sources import shared


def parquet_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Files called name in folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def hourly_counts(events: DataFrame, late: str = "30 days") -> DataFrame:
    """hour, event_type, n; windows close once events are ``late`` behind."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), "n")


def first_seen(rows: DataFrame, key: str, time: str = "ts", late: str = "30 days") -> DataFrame:
    """The first row of each key; keys are forgotten once they are ``late`` behind."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Use up what the stream's source holds, and give back what was written."""
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    sink.format("parquet").start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions below root."""
    found = [int(name) for name in shared.names(spark, root) if name.isdigit()]
    return sorted(n for n in found if "_SUCCESS" in shared.names(spark, f"{root}/{n}"))


def run_complete(stream: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Use up what the source holds, and give back the whole result after it: windows that no later event has closed too.

    Each batch writes the result as a table of its own below root; a batch that is run again writes it again.
    The last two stay. A run that finds nothing new gives the last result, or no rows before the first one.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{number}")
        for old in versions(spark, root)[:-2]:
            fs, path = shared.file_system(spark, f"{root}/{old}")
            fs.delete(path, True)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = versions(spark, root)[-1:]
    return spark.read.schema(stream.schema).parquet(f"{root}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def current(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[int]]:
    """bucket -> versions (below ``before``) that hold it, newest last: what a keyed table consists of. Buckets and versions are few."""
    held: dict[int, list[int]] = {}
    for n in versions(spark, root):
        for name in shared.names(spark, f"{root}/{n}"):
            if name.startswith("_bucket=") and (before is None or n < before):
                held.setdefault(int(name.removeprefix("_bucket=")), []).append(n)
    return held


def _buckets(spark: SparkSession, root: str, held: dict[int, list[int]], schema) -> DataFrame:
    paths = [f"{root}/{ns[-1]}/_bucket={b}" for b, ns in held.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_into(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> DataFrame:
    """A keyed table below root, by hash buckets of its keys: a batch rewrites the buckets that its keys fall into, others stay.

    A batch's version holds its buckets; a batch that is run again writes it again from
    what was there before, so that it counts once. Of each bucket the last two versions stay.
    Without any row so far the table is empty.
    """
    spark, schema = stream.sparkSession, stream.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        latest = keyed.pick(batch, keys, [F.col(c) for c in order]).withColumn("_bucket", bucket)
        touched = {r[0] for r in latest.select("_bucket").distinct().collect()}
        held = {b: ns for b, ns in current(spark, root, number).items() if b in touched}
        rows = keyed.pick(_buckets(spark, root, held, schema).unionByName(latest.drop("_bucket")), keys, [F.col(c) for c in order])
        rows.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{number}")
        for b, ns in current(spark, root).items():
            for old in ns[:-2]:
                fs, path = shared.file_system(spark, f"{root}/{old}/_bucket={b}")
                fs.delete(path, True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _buckets(spark, root, current(spark, root), schema)

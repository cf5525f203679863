"""A log of events by job: each event gets its job's next number, whatever batch it comes in, and readers go on from a number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.sources import shared

KEEP = 500


class _Numbers(StatefulProcessor):
    """The last number given out is all that is kept of a job; a batch's events are numbered in order of ``order``."""

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        first = self.last.get()[0] if self.last.exists() else 0
        held["sequence"] = range(first + 1, first + 1 + len(held))
        self.last.update((first + len(held),))
        yield held[[*self.columns, "sequence"]]

    def close(self) -> None:
        pass


def append_events(stream: DataFrame, root: str, checkpoint: str, job: str, order: list[str]) -> DataFrame:
    """Number what the stream holds, job by job, and append it to the log below root; the whole log so far.

    Of one batch, events are numbered in ``order``; a later batch's come after them. A batch that is run
    again writes its own part again, so numbers neither repeat nor skip.
    """
    spark, columns = stream.sparkSession, stream.columns
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state of this kind needs it
    schema = T.StructType([*stream.schema.fields, T.StructField("sequence", T.LongType())])
    numbered = stream.groupBy(job).transformWithStateInPandas(_Numbers(columns, order), schema, "Append", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    try:
        numbered.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(schema).parquet(root) if shared.names(spark, root) else spark.createDataFrame([], schema)


def replayed(log: DataFrame, job: str, after: DataFrame | None = None, keep: int = KEEP) -> DataFrame:
    """The last ``keep`` events of each job; with after (job, sequence) those that come after it, for the jobs named there."""
    rank = F.row_number().over(Window.partitionBy(job).orderBy(F.desc("sequence")))
    last = log.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")
    if after is None:
        return last
    asked = after.select(F.col(job).alias("_job"), F.col("sequence").alias("_after"))
    return last.join(asked, F.col(job) == F.col("_job")).where(F.col("sequence") > F.col("_after")).drop("_job", "_after")

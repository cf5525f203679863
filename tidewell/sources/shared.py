"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's objects, for whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    fs, p = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the application ends. On one machine, where that is unset, a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidewell/{label}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df by way of Parquet in the shared folder: what several joins read is computed once."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a join may send to all tasks.
FEW = 10_000


def met(df: DataFrame) -> DataFrame:
    """df, as ``written`` gave it, for a join: sent to all tasks if it has few rows, else both sides are sorted.

    Spark would go by the size of compressed files, which may be a hundredth of the rows', and what is sent the driver holds whole.
    """
    return df.hint("broadcast" if df.count() <= FEW else "merge")


def dealt(df: DataFrame, *keys: str, rows: int = 100_000) -> DataFrame:
    """df dealt by keys to tasks of some ``rows`` rows, and to all cores at least: a small file of very many rows is read by one task."""
    return df.repartition(tasks(df, rows), *keys)


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of some ``rows`` rows df is worth, all cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def rename_parts(spark: SparkSession, root: str, before: str, after: str) -> None:
    """Give the files below root that end in ``before`` another ending, as Spark names what it writes by its own rules."""
    fs, path = file_system(spark, root)
    found, paths = fs.listFiles(path, True), []
    while found.hasNext():
        paths.append(found.next().getPath())
    for p in paths:
        if p.getName().endswith(before):
            fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), p.getName().removesuffix(before) + after))

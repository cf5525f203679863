"""Sinks: versioned publication behind gates, packages with manifests, per-folder output.

A publication writes a new version beside the old ones and then names it in a
one-row pointer table; readers follow the pointer, so they see the old version or
the new one, whole. Paths go through Hadoop's file systems: nothing is local.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import gates


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions, oldest first; other folders don't count."""
    fs, p = _fs(spark, f"{root}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if len(n) == 20 and n.isdigit())


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The version that the newest pointer names, or None."""
    fs, p = _fs(spark, f"{root}/pointer")
    if not fs.exists(p):
        return None
    name = spark.read.parquet(f"{root}/pointer").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/versions/{name}")


def publish(df: DataFrame, root: str, retain_ratio: float = 0.5, keep: int = 5) -> str | None:
    """Write df as the current version, if the gate lets it through; the newest ``keep`` versions stay. None if it was rejected."""
    spark = df.sparkSession
    name = f"{time.time_ns():020d}"
    df.write.parquet(f"{root}/versions/{name}")
    written = spark.read.parquet(f"{root}/versions/{name}")
    before = current(spark, root)
    passed = not written.isEmpty() if before is None else gates.may_publish(written, before, retain_ratio)
    fs, p = _fs(spark, f"{root}/versions/{name}")
    if not passed:
        fs.delete(p, True)
        return None
    spark.createDataFrame([(name,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    for old in versions(spark, root)[:-keep]:
        fs.delete(_fs(spark, f"{root}/versions/{old}")[1], True)
    return name


def write_by_folder(df: DataFrame, path: str, folder: str, unknown: str = "unknown") -> None:
    """One subfolder for each value; blank values share one."""
    named = df.withColumn("_folder", F.coalesce(F.nullif(F.trim(folder), F.lit("")), F.lit(unknown)))
    named.repartition("_folder").write.partitionBy("_folder").parquet(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """All cells quoted, fields in order, lists joined; null is an empty cell."""
    shown = [F.array_join(F.col(c), "、").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string").alias(c) for c in fields]
    df.select(*shown).write.options(header=True, quoteAll=True, escape='"', nullValue="", emptyValue="").csv(path)


def write_package(datasets: dict[str, DataFrame], path: str) -> DataFrame:
    """Each dataset as JSON lines below path, and a manifest: name, n_rows, digest (order of rows aside)."""
    parts = []
    for name, df in datasets.items():
        df.write.json(f"{path}/{name}")
        parts.append(digest_of(df.sparkSession, path, name, df.schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.json(f"{path}/manifest")
    return out


def digest_of(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    """name, n_rows, digest of a written dataset; the digest adds up row hashes, so no task sees all rows."""
    rows = spark.read.schema(schema).json(f"{path}/{name}")
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rows.columns]))).cast("decimal(38,0)")
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def broken_datasets(spark: SparkSession, path: str, schemas: dict) -> list[str]:
    """Names whose rows don't meet the manifest, and names that it lacks or has besides."""
    said = {r["name"]: (r["n_rows"], r["digest"]) for r in spark.read.schema("name string, n_rows long, digest string").json(f"{path}/manifest").collect()}
    bad = set(said) ^ set(schemas)
    for name in set(said) & set(schemas):
        r = digest_of(spark, path, name, schemas[name]).first()
        if (r["n_rows"], r["digest"]) != said[name]:
            bad.add(name)
    return sorted(bad)


def write_response(df: DataFrame, root: str, fields: list[str] | None, version: str, updated_at: str) -> DataFrame:
    """Shown fields of df as compressed JSON lines, and their one-row meta: version, count, digest, updated_at.

    A response of the same version and fields is not built again: its meta comes back. Fields that df lacks
    are left out, nulls are "". The meta is written last, so a build that died counts as none.
    """
    spark = df.sparkSession
    shown = [c for c in (fields if fields is not None else df.columns) if c in df.columns]
    name = hashlib.sha256(json.dumps([version, shown]).encode()).hexdigest()
    path, schema = f"{root}/{name}", "version string, count long, digest string, updated_at string"
    fs, done = _fs(spark, f"{path}/meta/_SUCCESS")
    if not fs.exists(done):
        rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in shown])
        rows.write.mode("overwrite").option("compression", "gzip").json(f"{path}/records")
        meta = digest_of(spark, path, "records", rows.schema).select(F.lit(version).alias("version"), F.col("n_rows").alias("count"), "digest", F.lit(updated_at).alias("updated_at"))
        meta.write.mode("overwrite").json(f"{path}/meta")
    return spark.read.schema(schema).json(f"{path}/meta").withColumn("path", F.lit(f"{path}/records"))


def write_bundle(df: DataFrame, root: str, fields: list[str], normalize: Callable[[DataFrame], DataFrame] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows, made alike by ``normalize``, as CSV and JSON lines, sorted by ``order`` over all files, and a summary: n_rows, digest, and both paths.

    A sheet of a spreadsheet program can't hold a large table: the CSV stands for it.
    """
    spark = df.sparkSession
    rows = (df if normalize is None else df.transform(normalize)).select(*fields)
    (rows if order is None else rows.orderBy(*order)).write.json(f"{root}/lines")
    written = spark.read.schema(rows.schema).json(f"{root}/lines")
    write_csv(written if order is None else written.orderBy(*order), f"{root}/csv", fields)
    summary = digest_of(spark, root, "lines", rows.schema).select("n_rows", "digest", F.lit(f"{root}/csv").alias("csv_path"), F.lit(f"{root}/lines").alias("lines_path"))
    summary.write.json(f"{root}/summary")
    return summary


def import_seed(rows: DataFrame, archive: DataFrame, root: str, flag: str) -> DataFrame:
    """A seed that met its contract: the source as it was below archive, its rows below seed, and a manifest with count, digest and how many flags are true and false."""
    spark = rows.sparkSession
    archive.write.parquet(f"{root}/archive")
    rows.write.json(f"{root}/seed")
    is_flag = lambda x: F.count_if(F.col(flag) == x).alias(f"n_{x}")
    n = spark.read.schema(rows.schema).json(f"{root}/seed").agg(is_flag("true"), is_flag("false")).first()
    manifest = digest_of(spark, root, "seed", rows.schema).select("*", F.lit(n["n_true"]).alias("n_true"), F.lit(n["n_false"]).alias("n_false"))
    manifest.write.json(f"{root}/manifest")
    return spark.read.schema("name string, n_rows long, digest string, n_true long, n_false long").json(f"{root}/manifest")


#: Bytes that a package and one of its datasets may have.
MOST_BYTES, MOST_MEMBER = 64 << 20, 48 << 20


def sizes(spark: SparkSession, path: str, most: int = MOST_BYTES, member: int = MOST_MEMBER) -> DataFrame:
    """name, bytes, error of a package's datasets: one that is too large, or all of them if together they are. Files aren't opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", "length")
    rows = found.groupBy(F.element_at(F.split("path", "/"), -2).alias("name")).agg(F.sum("length").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))  # a row for each dataset
    return rows.withColumn("error", F.when(total > most, "package too large").when(F.col("bytes") > member, "dataset too large")).where("name <> 'manifest'")

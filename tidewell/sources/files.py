"""Scans of text files: CSV with blanks kept, JSON lines, Markdown trees. All columns are strings unless said."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import front_matter, markdown_title
from tidewell.sources.shared import names


class InputError(ValueError):
    """A file that doesn't meet its contract."""


def csv_text(spark: SparkSession, path: str, header: list[str] | None = None, required: list[str] = ()) -> DataFrame:
    """CSV with a header, quoted line ends and a byte-order mark; a missing cell is "", never null.

    With ``header``, the columns must be these, in this order; ``required`` names columns that must be there.
    """
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if header is not None and df.columns != list(header):
        raise InputError(f"columns {df.columns}, not {list(header)}")
    if missing := sorted(set(required) - set(df.columns)):
        raise InputError(f"no columns {missing}")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def contract_csv(spark: SparkSession, path: str, contracts: dict[str, list[str]], flag: str, implied: set[str] = frozenset()) -> DataFrame:
    """CSV whose header is one of the contracts (name -> columns), in the columns of the first contract; blank rows are left out.

    ``flag`` is a column of true or false: contracts named in ``implied`` lack it, and their rows count as true; elsewhere
    another value is an error, as is a file without rows. Columns that a contract lacks are "".
    """
    df = csv_text(spark, path)
    name = next((k for k, columns in contracts.items() if df.columns == list(columns)), None)
    if name is None:
        raise InputError(f"columns {df.columns} are those of no contract")
    rows, columns = without_blank_rows(df), next(iter(contracts.values()))
    said = F.lit("true") if name in implied else F.lower(F.trim(F.regexp_replace(flag, r"\s+", " ")))
    out = rows.select(*[(said if c == flag else F.col(c) if c in df.columns else F.lit("")).alias(c) for c in columns])
    bad, n = out.agg(F.sum((~F.col(flag).isin("true", "false")).cast("long")), F.count("*")).first()
    if not n or bad:
        raise InputError(f"{bad or 'no'} rows" + (f" with another {flag} than true or false" if bad else ""))
    return out


def typed_csv(spark: SparkSession, path: str, columns: list[str], lists: list[str], strict: bool = False) -> DataFrame:
    """CSV of these columns (all, in this order, if strict), missing ones "", with ``lists`` read from JSON arrays, blanks left out.

    A cell of a list that is neither blank nor a JSON array is an error of the whole file.
    """
    df = csv_text(spark, path)
    if strict and df.columns != list(columns) or set(df.columns) - set(columns):
        raise InputError(f"columns {df.columns}, not {list(columns)}")
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit("")).alias(c) for c in columns])
    parsed = {c: F.from_json(F.when(F.trim(c) == "", F.lit("[]")).otherwise(F.col(c)), "array<string>") for c in lists}
    is_list = lambda c: (F.trim(c) == "") | (F.trim(c).rlike(r"(?s)^\[.*\]$") & parsed[c].isNotNull())
    if not rows.where(~reduce(lambda a, b: a & b, [is_list(c) for c in lists], F.lit(True))).isEmpty():
        raise InputError(f"a cell of {lists} is no JSON array")
    tidy = {c: F.filter(F.transform(parsed[c], lambda x: F.trim(x)), lambda x: x != "") for c in lists}
    return rows.select(*[(tidy[c] if c in lists else F.col(c)).alias(c) for c in columns])


def without_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with some cell that isn't blank."""
    return df.where(F.exists(F.array(*[F.col(c).cast("string") for c in df.columns]), lambda x: F.trim(x) != ""))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank and unreadable lines are left out."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(marked).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.coalesce(*[F.col(f.name).cast("string") for f in schema.fields]).isNotNull() & F.col("_bad").isNull())
    return rows.select(*schema.names)


def json_lines_or_csv(spark: SparkSession, lines: str, csv: str, columns: list[str]) -> DataFrame:
    """JSON lines, or the CSV twin if they hold no row."""
    rows = json_lines(spark, lines, T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return csv_text(spark, csv).select(*columns) if rows.isEmpty() else rows


def markdown_rows(rows: DataFrame) -> DataFrame:
    """path, folder (the parent's name), text, sha256, n_chars, title, meta of documents (text, path)."""
    meta = front_matter(F.col("text"))
    return rows.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("folder"), "text", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"),
        F.coalesce(F.nullif(F.try_element_at(meta, F.lit("title")), F.lit("")), markdown_title(F.col("text"))).alias("title"), meta.alias("meta"),
    )


def markdown_tree(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """markdown_rows of every *.md below path."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumnRenamed("value", "text")
    out = markdown_rows(rows.withColumn("path", F.col("_metadata.file_path")))
    return out if folder is None else out.where(F.col("folder") == folder)


def latest_documents(spark: SparkSession, manifests: str, folder: Callable[[str, str], str]) -> DataFrame:
    """markdown_tree of the generations that their owners' manifests name, with owner; those whose manifest can't be read or says that its gate wasn't passed are left out.

    manifests is a pattern of paths .../owner=<owner>/<file>.json of JSON with quality_passed and output; ``folder`` gives an
    owner's generation's path. Owners are few: their paths are all that the driver sees.
    """
    read = spark.read.text(manifests, wholetext=True).select(F.regexp_extract("_metadata.file_path", "/owner=([^/]+)/", 1).alias("owner"), F.try_parse_json("value").alias("v"))
    good = read.where(F.coalesce(F.try_variant_get("v", "$.quality_passed", "boolean"), F.lit(False))).select("owner", F.try_variant_get("v", "$.output", "string").alias("output"))
    chosen = [tuple(r) for r in good.where("output <> ''").distinct().collect()]
    paths = [folder(owner, output) for owner, output in sorted(chosen)]
    if not paths:
        return markdown_rows(spark.createDataFrame([], "text string, path string")).withColumn("owner", F.lit(""))
    rows = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return markdown_rows(rows).withColumn("owner", F.regexp_extract("path", "/owner=([^/]+)/", 1))


def admitted(documents: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents with text and title whose content (sha256) is neither processed before nor a repeat; of repeats the first path stays."""
    fresh = documents.where("trim(text) <> '' AND title IS NOT NULL").join(processed.select("sha256").distinct(), "sha256", "left_anti")
    first = fresh.groupBy("sha256").agg(F.min("path").alias("_path"))
    return fresh.join(first, "sha256").where("path = _path").drop("_path")


def notice_index(documents: DataFrame, notice_type: str, other: str = "procurement") -> DataFrame:
    """Documents of a type by their notice_id, the first path of each; a document that names no type counts as ``other``."""
    of = lambda key: F.coalesce(F.try_element_at(F.col("meta"), F.lit(key)), F.lit(""))
    shown = [of(k).alias(k) for k in ("title", "publish_time", "purchaser", "region", "keyword")]
    rows = documents.select(of("notice_id").alias("notice_id"), F.coalesce(F.nullif(of("notice_type"), F.lit("")), F.lit(other)).alias("notice_type"), F.struct("path", *shown).alias("_r"))
    return rows.where((F.col("notice_id") != "") & (F.col("notice_type") == notice_type)).groupBy("notice_type", "notice_id").agg(F.min_by("_r", "_r.path").alias("_r")).select("notice_type", "notice_id", "_r.*")


def source_catalog(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """A JSON document's brokers as a typed table: counts at least 1, the ratio within 0 and 1, defaults where a key is missing.

    Keys given twice, and sources without key, broker_name or collector, are an error of the whole file.
    """
    schema = "brokers array<struct<key:string,broker_name:string,collector:string,enabled:boolean,pages:int,page_size:int,min_content_chars:int,min_detail_success_ratio:double,aliases:array<string>,settings:map<string,string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("brokers"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("min_detail_success_ratio", F.lit(0.8))))
    out = rows.select(
        "key", "broker_name", "collector", F.coalesce("enabled", F.lit(False)).alias("enabled"), *[F.greatest(F.lit(1), F.coalesce(c, F.lit(d))).alias(c) for c, d in (("pages", 1), ("page_size", 10), ("min_content_chars", 80))],
        ratio.alias("min_detail_success_ratio"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "settings",
    )
    n, keys, bad = out.agg(F.count("*"), F.count_distinct("key"), F.count_if(F.col("key").isNull() | F.col("broker_name").isNull() | F.col("collector").isNull())).first()
    if not n or bad or n != keys:
        raise InputError(f"{n} sources, {keys} keys, {bad} without key, broker_name or collector")
    return out.where("enabled") if enabled_only else out


def json_documents(spark: SparkSession, root: str, expected: dict[str, str | None]) -> DataFrame:
    """name, document (variant), error: one row for each expected document <name>.json below root.

    expected gives the JSON that stands for a document that is missing, unreadable or no object, as for a
    state that starts anew; with None that is an error instead, as for a cache or a manifest.
    """
    asked = F.broadcast(spark.createDataFrame(list(expected.items()), "name string, fallback string"))  # few names
    there = [f"{root}/{n}.json" for n in expected if f"{n}.json" in names(spark, root)]
    schema = "name string, text string"
    found = spark.read.text(there, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("name"), F.col("value").alias("text")) if there else spark.createDataFrame([], schema)
    rows = asked.join(found, "name", "left").withColumn("_v", F.try_parse_json("text"))
    kind = F.coalesce(F.schema_of_variant("_v"), F.lit(""))
    good = F.startswith(kind, F.lit("OBJECT"))
    error = F.when(F.col("text").isNull(), "missing").when(F.col("_v").isNull(), "unreadable").when(~good, "no object")
    return rows.select("name", F.when(good, F.col("_v")).otherwise(F.parse_json("fallback")).alias("document"), F.when(F.col("fallback").isNull(), error).alias("error"))

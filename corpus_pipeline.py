"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet to the shared folder and read again as the next
one's input. All but the last return the columns of documents:

1. quality: documents that the quality classifier rejects go;
2. near_dedup: of each group of near duplicates (80 % of their shingles in common) the smallest doc_id stays;
3. secrets: the spans found are masked in the text;
4. mixing: documents as often as the source weights take them, cut to the words taken;
5. packing: the pieces of all that is left with their token ids, in sequences of 2048 tokens.

Rows are kept with nulls in any column: a null doc_id can't be told apart and
passes the first two stages, a null text has no words and ends with mixing. Of rows
that repeat in doc_id and text the second stage keeps one; rows of one doc_id with other texts are judged each.
Ties go by doc_id or by a seeded hash, texts are taken whole whatever their length, an
empty table gives no rows, and further columns of documents, whatever their names, reach the
last stage, which gives its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import load, materialize
from tidewell.llm.mixing import mixed_documents
from tidewell.llm.near_dedup import keep_one
from tidewell.llm.packing import pack_documents
from tidewell.llm.quality_model import keep_good
from tidewell.llm.secret_scan import redact

#: Of near duplicates: per cent of the shingles of both texts that both have.
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, SIMILAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Near duplicates and the classifier can't be expressed in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the table documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

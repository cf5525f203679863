"""What the operators share: where intermediate tables go, words, word hashes.

Intermediate tables are written as Parquet below the folder named by
``spark.checkpoint.dir``, which driver and executors share, so that a lost
executor costs no more than the tasks of one step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of the white space between words (also the complement of a word's characters).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine (tests), a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/tidewell/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row.

    Higher-order functions evaluate what their lambda captures for every
    element; bound as a lambda variable, an array is computed only once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; a memo that starts anew beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and xor-shift), over a whole array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small where the session leaves their size open."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "16m"),
    ):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)

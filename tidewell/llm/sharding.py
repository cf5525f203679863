"""Sharding by extendible hashing, with DataFrame functions only.

A row's hash is a string of bits. The directory is a tree of hash prefixes:
a bucket over the byte limit splits on its next bit, and nothing else splits, so
every shard is the shortest prefix of its rows that fits. Bytes are summed once
at ``MAX_BITS`` bits, and the tree is read off those sums, not off the rows.

What bits can't part: a row over the limit is alone in its shard, which stops at
the depth that isolates it; rows with one hash (repeated keys) fill numbered
overflow shards in turn.

Defined cases: null texts have 0 bytes; a null doc_id hashes as a value of its
own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

#: Bits that the directory can use; 2**40 shards.
MAX_BITS = 40
LIMIT = 512 << 10


def hash_bits(key: Column) -> Column:
    """The first MAX_BITS bits of the key's MD5, as a number below 2**MAX_BITS."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, MAX_BITS // 4), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """sized (h, bytes) -> prefix, depth, bytes, hashes of every shard.

    Level by level from the root, oversized buckets alone go one bit deeper. The
    levels that an even hash needs, and eight more, come from one pass: rows are
    summed at the deepest of them, those sums make the levels above. Only
    buckets still too large there go on to deeper levels.
    """
    cells = materialize(sized.groupBy("h").agg(F.sum("bytes").alias("bytes")), "cells")
    total = cells.agg(F.sum("bytes")).first()[0] or 0
    first, deep = 0, min(MAX_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 8)
    leaves, rest = [], cells
    while True:
        low = rest.groupBy(F.shiftright("h", MAX_BITS - deep).alias("low")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("hashes"))
        levels = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("low", deep - d).alias("prefix")) for d in range(first, deep + 1)])
        sums = low.select(F.explode(levels).alias("p"), "bytes", "hashes").groupBy("p.depth", "p.prefix")
        sums = materialize(sums.agg(F.sum("bytes").alias("bytes"), F.sum("hashes").alias("hashes")), "sums")
        fits = (F.col("bytes") <= limit) | (F.col("hashes") == 1) | (F.col("depth") == MAX_BITS)
        split = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
        fit = sums.where(fits).withColumn("_parent", F.shiftright("prefix", 1))
        top = fit.where((F.col("depth") == first)).drop("_parent")
        leaves += [top, fit.join(split, ["depth", "_parent"], "left_semi").select("depth", "prefix", "bytes", "hashes")]
        large = materialize(sums.where(~fits & (F.col("depth") == deep)).select(F.col("prefix").alias("_large")), "large")
        if large.isEmpty():
            break
        rest = materialize(rest.join(large, F.shiftright("h", MAX_BITS - deep) == F.col("_large"), "left_semi"), "rest")
        first, deep = deep + 1, min(MAX_BITS, deep + 8)
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return materialize(out, "directory")


def assign_shards(documents: DataFrame, limit: int = LIMIT, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, bytes, depth, shard: one row for each row of documents; the shard's name is its bits, then +k in overflow."""
    sized = documents.select(F.col(key), hash_bits(F.col(key)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    sized = materialize(sized, "sized")
    shards = directory(sized, limit)
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # MAX_BITS + 1 numbers at most
    if not depths:
        return sized.select(key, "bytes", F.lit(0).alias("depth"), F.lit("").alias("shard"))
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", MAX_BITS - d).alias("prefix")) for d in sorted(depths)])
    rows = sized.select(key, "h", "bytes", F.explode(tries).alias("p")).select(key, "h", "bytes", "p.*")
    rows = rows.join(shards.withColumnRenamed("bytes", "_all"), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    rows = rows.select(key, "h", "bytes", "depth", name.alias("shard"), (F.col("_all") > limit).alias("_over"))
    # numbered once and written, so that a task run again finds the same order
    over = rows.where("_over").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    over = materialize(over, "over")
    kept = rows.where("NOT _over").select(key, "bytes", "depth", "shard")
    if over.isEmpty():
        return kept
    # rows that no bit parts: numbered by bytes before them, within their task and then across tasks
    task = Window.partitionBy("shard", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = over.withColumn("_at", F.sum("bytes").over(task) - F.col("bytes"))
    sums = over.groupBy("shard", "_part").agg(F.sum("bytes").alias("_bytes"), F.max("bytes").alias("_m"))
    of = Window.partitionBy("shard")
    sums = sums.withColumns({"_before": F.sum("_bytes").over(of.orderBy("_part")) - F.col("_bytes"), "_most": F.max("_m").over(of)})
    placed = placed.join(sums.select("shard", "_part", "_before", "_most"), ["shard", "_part"])
    width = F.greatest(F.lit(1), F.lit(limit) - F.col("_most"))
    number = F.floor((F.col("_before") + F.col("_at")) / width)
    placed = placed.withColumn("shard", F.concat("shard", F.lit("+"), number.cast("string")))
    return kept.unionByName(placed.select(key, "bytes", "depth", "shard"))


def write_shards(documents: DataFrame, folder: str, limit: int = LIMIT, key: str = "doc_id") -> None:
    """Write documents (no column of which is called shard) below folder, one subfolder a shard; keys must not repeat."""
    where = assign_shards(documents, limit, key).select(F.col(key).alias("own"), "shard")
    rows = documents.select(F.struct("*").alias("row"), F.col(key).alias("key"))
    rows = rows.join(where, F.col("key").eqNullSafe(F.col("own"))).select("row.*", "shard")
    rows.repartition("shard").write.partitionBy("shard").parquet(folder)

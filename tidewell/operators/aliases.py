"""Texts and the longest alias that each holds, for a table of aliases of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.shared import written

#: Bits of the filter of aliases (16 MB, whatever their number; 32,768 or a multiple), how many of a text's pieces that pass it are looked up at first, characters hashed at a time.
BITS, FIRST, BLOCK = 1 << 27, 8, 400_000
ODD, FORTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


class _Pieces:
    """Texts as one row of code points; the hash of a piece of them comes from sums up to its ends."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        sizes, n = np.array([len(x) for x in texts], np.int64), len(self.codes)
        self.starts, self.owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # characters from a place to its text's end
        mixed = (self.codes.astype(np.uint64) + np.uint64(1)) * ODD
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.cumprod(np.full(n, BACK))
        self.sums, self.forth = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)]), np.cumprod(np.full(n, FORTH))

    def slots(self, at: np.ndarray, length: int | np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The two of a filter's n bits that stand for the pieces that begin at these places."""
        h = (self.sums[at + length] - self.sums[at]) * self.forth[at]
        h = (h ^ (h >> np.uint64(31))) * ODD
        h ^= h >> np.uint64(29)
        return tuple((x % np.uint64(n)).astype(np.int64) for x in (h, h >> np.uint64(32)))

    def text(self, at: int, length: int) -> str:
        return self.codes[at : at + length].tobytes().decode("utf-32-le")


def _filter(known: DataFrame) -> bytes:
    """A Bloom filter of all aliases, whose parts of 4 KB Spark puts together: its size doesn't depend on theirs."""
    n = BITS

    def slots(s: pd.Series) -> pd.Series:
        pieces = _Pieces(s.tolist())
        # Spark's bitmaps number from 1
        return pd.Series(list(np.stack(pieces.slots(pieces.starts, s.str.len().to_numpy(), n), axis=1) + 1))

    bit = known.select(F.explode(F.pandas_udf(slots, "array<long>")("alias")).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = bytearray(n // 8)
    for part, bits in parts:
        out[(part - 1) * 4096 : part * 4096] = bits
    return bytes(out)


def _passing(texts: DataFrame, key: str, lengths: list[int], bits: Broadcast, first: int | None) -> DataFrame:
    """key, piece, low of texts (key, _t, _below): pieces shorter than _below that pass the filter, those of the longest lengths first.

    After the length with which a text has ``first`` pieces its shorter ones are left for later; low is that length, or 0 if all are there.
    """
    schema = T.StructType([texts.schema[key], T.StructField("piece", T.StringType()), T.StructField("low", T.IntegerType())])

    def passing(texts: list[str], below: np.ndarray) -> tuple[list[tuple[int, str]], np.ndarray]:
        held, pieces, out = np.frombuffer(bits.value, np.uint8), _Pieces(texts), []
        count, low = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int32)
        for length in lengths:
            still = (low == 0) & (length < below)
            at = np.flatnonzero(still[pieces.owner] & (pieces.left >= length))
            one, two = (held[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 for slot in pieces.slots(at, length, 8 * len(held)))
            at = at[(one & two) == 1]
            found = {(int(pieces.owner[i]), pieces.text(i, length)) for i in at}
            out += found
            count += np.bincount([i for i, _ in found], minlength=len(texts)).astype(np.int64)
            if first:
                low[still & (count >= first)] = length
        return out, low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["_t"].str.len().cumsum() // BLOCK):
                out, low = passing(part["_t"].tolist(), part["_below"].to_numpy())
                if not out:
                    continue
                own = np.array([i for i, _ in out], np.int64)
                yield pd.DataFrame({key: part[key].to_numpy()[own], "piece": [x for _, x in out], "low": low[own]})

    return texts.select(key, "_t", "_below").mapInPandas(run, schema)


def longest_alias(texts: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, alias: of the aliases (name, alias) that a text holds, a longest one; of ties, that of the greatest name, then the greatest alias. Keys are unique.

    Pieces of a text of the aliases' lengths go through a Bloom filter of all aliases, and the longest that pass are looked up by an
    equi-join, which is exact. Only a text of which none of these is an alias has its other pieces looked up. So neither texts nor all
    their pieces are shuffled. Texts without any alias are left out.
    """
    known = written(aliases.where("alias <> ''").groupBy("alias").agg(F.max("name").alias("name")), "aliases")
    lengths = sorted((r[0] for r in known.select(F.length("alias")).distinct().collect()), reverse=True)
    bits = known.sparkSession.sparkContext.broadcast(_filter(known))
    rows = texts.select(key, F.col(text).alias("_t")).where((F.col("_t") != "") & F.col(key).isNotNull())

    def looked_up(pieces: DataFrame) -> DataFrame:
        best = F.max(F.when(F.col("alias").isNotNull(), F.struct(F.length("alias").alias("l"), "name", "alias")))
        return pieces.join(known, F.col("piece") == F.col("alias"), "left").groupBy(key).agg(best.alias("_b"), F.max("low").alias("_below"))

    tried = written(looked_up(_passing(rows.withColumn("_below", F.lit(2**31 - 1)), key, lengths, bits, FIRST)), "owners")
    rest = written(tried.where("_b IS NULL AND _below > 0").select(key, "_below"), "owners")
    others = looked_up(_passing(rows.join(rest, key), key, lengths, bits, None))
    return tried.unionByName(others).where("_b IS NOT NULL").select(key, "_b.name", "_b.alias")


def identified(documents: DataFrame, aliases: DataFrame, key: str, beginning: int = 4000) -> DataFrame:
    """key, name: whose document each is. documents: key, configured, owner, purchaser, title, body.

    A configured name that aliases has counts first; then the longest alias in owner, purchaser, title or the
    body's beginning; then a purchaser (or owner) with 证券 in it gives a name of its own, by the hash of
    the name without its legal form; else the name is empty.
    """
    searched = _bare(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("owner", "purchaser", "title")], F.substring(F.coalesce("body", F.lit("")), 1, beginning)))
    found = longest_alias(documents.withColumn("_s", searched), aliases, key, "_s").select(F.col(key).alias("_k"), F.col("name").alias("_found"))
    names = aliases.select(F.col("name").alias("_n")).distinct()
    rows = documents.join(names, F.col("configured") == F.col("_n"), "left").join(found, F.col(key) == F.col("_k"), "left")
    buyer = _bare(F.coalesce(F.nullif("owner", F.lit("")), "purchaser"))
    hashed = F.concat(F.lit("broker_"), F.substring(F.sha1(F.regexp_replace(buyer, "(?:股份有限公司|有限责任公司|有限公司)$", "")), 1, 12))
    own = F.when(F.contains(buyer, F.lit("证券")), hashed).otherwise("")
    return rows.select(key, F.coalesce("_n", "_found", own).alias("name"))

"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share 150 % of all words; a target stops at twice its source's size and the
excess is shared again by weight until none is above.

Blocks: the mix holds ``total / block`` blocks. Sainte-Lague gives each source
its number of blocks (highest quotients target / (2 k + 1)), then each source's
number is apportioned to its shards by their sizes in the same way. Within a
shard, documents lie in seeded order and are cut into blocks; every block is
taken quota // n times, and a seeded, evenly spaced choice of quota % n blocks
once more. So a document is taken at most twice, since quotas stop at twice a
shard's blocks.

A shard holds some 50,000 words of one source, or more in a large corpus, so a hot source is
spread over many shards. Per-source and per-shard tables are the only ones that
the arithmetic meets whole, and they are grouped, not gathered.

Defined cases: null texts have size 0 and are taken 0 times; a null source is a
source of its own; repeated rows are dealt like others; sources without words
have target 0; an empty table gives no rows; further columns are ignored by ``mix``
and given back by ``mixed_documents``, whatever their names. Reruns
agree, as all choices hash doc_id and text with the seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import SPACE, materialize, small_batches

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 32
SHARD_WORDS = 50_000
SEED = 7


def words_of(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
    return F.size(words).cast("long")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size), one row each -> with weight and target.

    The level at which targets stand is found by repeated sums over the table:
    sources whose weight at that level exceeds their cap leave the sharing.
    """
    # names only, one row a source: ranked within range partitions, which are then counted off
    parts = sources.select("source", "source_size").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    parts = materialize(parts, "sources")
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    ranked = parts.join(before, "_p").withColumn("_rank", rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", "_rank", weight.alias("weight")), "ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, most = 0.0, F.col("source_size") * F.lit(float(cap))
    while True:
        capped = most <= F.col("weight") * level if level else F.lit(False)
        row = ranked.agg(F.sum(F.when(capped, most)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        new = (total - (row["full"] or 0.0)) / row["w"] if row["w"] else level
        if new <= level or not row["w"]:
            break
        level = new
    return ranked.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def sainte_lague(parties: DataFrame, key: str, group: list[str], votes: str, seats: str) -> DataFrame:
    """parties with ``quota``: seats of its group by highest quotients votes / (2 k + 1).

    Rounding votes * seats / all gives each party its quotients above one
    divisor. What is then missing (or over) are the next-highest (or the lowest
    taken) quotients of the group; a party with the share p of the votes can own
    no more than p * (missing + parties) + 1 of them, so that many are ranked.
    Ties go to the smaller key.
    """
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total = F.sum(votes).over(of)
    share = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    out = parties.withColumns({"_share": share, "_k": F.count("*").over(of)})
    out = out.withColumn("_q", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
    out = out.withColumn("_off", F.when(F.sum(votes).over(of) > 0, F.col(seats) - F.sum("_q").over(of)).otherwise(F.lit(0)))
    most = F.floor(F.col("_share") * (F.abs("_off") + F.col("_k"))) + 2
    most = F.when((F.col("_off") == 0) | (F.col(votes) <= 0), 0).when(F.col("_off") < 0, F.least(most, F.col("_q"))).otherwise(most)
    steps = F.when(most > 0, F.sequence(F.lit(1).cast("long"), most.cast("long")))
    rows = out.withColumn("_j", F.explode_outer(steps))
    up = F.col("_off") > 0
    quotient = F.col(votes) / F.when(up, 2 * (F.col("_q") + F.col("_j")) - 1).otherwise(2 * (F.col("_q") - F.col("_j")) + 1)
    rows = rows.withColumn("_by", F.when(F.col("_j").isNotNull(), F.when(up, -quotient).otherwise(quotient)))
    place = F.row_number().over(of.orderBy(F.col("_by").asc_nulls_last(), F.when(up, F.col(key)).otherwise(-F.col(key)), "_j"))
    rows = rows.withColumn("_in", (F.col("_j").isNotNull() & (place <= F.abs("_off"))).cast("long"))
    chosen = rows.groupBy(*parties.columns, "_q", "_off").agg(F.sum("_in").alias("_in"))
    return chosen.withColumn("quota", F.col("_q") + F.signum("_off").cast("long") * F.col("_in")).drop("_q", "_off", "_in")


def _placed(documents: DataFrame, block: int, seed: int) -> DataFrame:
    """Each document's place in its shard, and the shard's blocks and quota."""
    sized = documents.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h")
    )
    sized = materialize(sized, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources)
    sums = targets.agg(F.sum("target"), F.sum("source_size")).first()
    targets = targets.withColumn("_seats", F.lit(round((sums[0] or 0.0) / block)).cast("long"))
    targets = sainte_lague(targets, "_rank", [], "target", "_seats").withColumnRenamed("quota", "_blocks")
    targets = materialize(targets.select(F.col("source").alias("_source"), "source_size", "target", "_blocks"), "targets")
    # shards grow with the square root of the corpus: neither their number nor their size becomes large
    per_shard = max(SHARD_WORDS, round(10 * (sums[1] or 0) ** 0.5))
    shard = F.pmod(F.col("_h"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard))).cast("int")
    dealt = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", shard)
    dealt = materialize(dealt, "dealt")
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_seats"))
    shards = sainte_lague(shards, "shard", ["source"], "_words", "_seats")
    n = F.ceil(F.col("_words") / block).cast("long")
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), n.alias("_n"), F.least("quota", n * CAP).alias("_quota"))
    order = Window.partitionBy("source", "shard").orderBy("_h", "doc_id")
    begin = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("_begin", begin)
    return placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")


def _chosen_before(place: Column, block: int, seed: int) -> Column:
    """Words before a place in its shard that lie in blocks chosen once more.

    Of n blocks, block j is chosen if (j * r + s) / n passes a whole number, for
    r = quota % n and a seeded s: r blocks, evenly spaced.
    """
    n, r = F.col("_n"), F.col("_quota") % F.col("_n")
    s = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), n)
    passed = lambda j: F.floor((j * r + s) / n)
    j = F.floor(place / block)
    return passed(j) * block + (passed(j + 1) - passed(j)) * (place % block)


def mix(documents: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted): one row for each row of documents."""
    placed = _placed(documents, block, seed)
    begin, end = F.col("_begin"), F.col("_begin") + F.col("size")
    again = _chosen_before(end, block, seed) - _chosen_before(begin, block, seed)
    taken = F.when(F.col("_n") > 0, F.floor(F.col("_quota") / F.col("_n")) * F.col("size") + again).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _cut(block: int, text_at: int, n_chars_at: int | None):
    """Batches whose last columns are _n, _quota, _s, _begin: rows repeated, or cut to the chosen blocks. Columns are told by their places."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def again(text: str, n: int, r: int, s: int, begin: int) -> str:
        spans = [m.span() for m in word.finditer(text)]
        runs: list[list[int]] = []
        for j in range(begin // block, (begin + len(spans) - 1) // block + 1):
            if (j + 1) * r + s >= ((j * r + s) // n + 1) * n:
                first, last = max(0, j * block - begin), min(len(spans), (j + 1) * block - begin)
                if runs and runs[-1][1] == first:
                    runs[-1][1] = last
                else:
                    runs.append([first, last])
        if runs == [[0, len(spans)]]:
            return text
        return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 4
            at, texts = [], []
            columns = [batch.column(i).to_pylist() for i in (text_at, *range(width, width + 4))]
            for i, (text, n, quota, s, begin) in enumerate(zip(*columns, strict=True)):
                if not n or not text or not text.strip(" \t\n\r\x0b\x0c"):
                    continue
                copies = [text] * (quota // n)
                if quota % n and (more := again(text, n, quota % n, s, begin)):
                    copies.append(more)
                at += [i] * len(copies)
                texts += copies
            out = batch.take(pa.array(at, pa.int64())).select(list(range(width)))
            for k, values in ((text_at, texts), (n_chars_at, [len(t) for t in texts])):
                if k is not None:
                    out = out.set_column(k, out.schema.field(k), pa.array(values, out.schema.field(k).type))
            yield out

    return run


def mixed_documents(documents: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, in the columns of documents: whole rows as often as they are taken whole, and rows cut to blocks taken once more."""
    small_batches(documents.sparkSession)
    keys = F.col("_n"), F.col("_quota"), F.when(F.col("_n") > 0, F.pmod(F.xxhash64("source", "shard", F.lit(seed)), "_n")).alias("_s"), F.col("_begin")
    places = _placed(documents, block, seed).select(F.col("doc_id").alias("_doc"), "_h", *keys)
    # equal rows lie side by side in the shard: they pair off by number, so that no place is used twice
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[-1]))
    places = places.withColumn("_nth", nth("_doc", "_h")).withColumnRenamed("_h", "_hash")
    # documents' columns go by their places, as they may have any names
    names = documents.columns
    row = [F.col("row")[c].alias(f"c{i}") for i, c in enumerate(names)]
    keyed = documents.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("doc_id", "text", F.lit(seed)).alias("_h"))
    keyed = keyed.withColumn("_k", nth("doc_id", "_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_hash")) & (F.col("_k") == F.col("_nth"))
    rows = keyed.join(places, same).select(*row, "_n", "_quota", "_s", "_begin")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, True, f.metadata) for i, f in enumerate(documents.schema)])
    cut = _cut(block, names.index("text"), names.index("n_chars") if "n_chars" in names else None)
    return rows.mapInArrow(cut, schema).toDF(*names)

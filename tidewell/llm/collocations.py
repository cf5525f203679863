"""Phrase collocations by contiguous pattern growth, after PrefixSpan.

1. Each occurrence of a word is projected: its pointer carries the words to its right that
   a pattern can reach, up to the end of the piece (``max_words`` in all). Pointers go to the task of
   their prefix, which is a bucket by the hash of language and first word. Equal
   projections of one task are combined with their number, words are sent once a block as a small dictionary.
2. A task sorts a bucket's projections; each prefix's projected occurrences are then
   a run. Frequent prefixes (``least`` occurrences) are extended to the right depth-first,
   each extension a run within its prefix's run, until it is infrequent or of full length. As any
   beginning of a frequent phrase is frequent, nothing is missed.
3. The phrases' numbers are joined to those of the parts of each cut; the lowest-scoring
   cut counts, and a phrase goes if a longer one holds most of its occurrences.

Hot prefixes: a word with more occurrences than a bucket should hold is a prefix too large for one
task. A projection goes by its first word, and while that is hot by the next one too; if
all its words are hot, it may go anywhere. What the tasks of longer prefixes count of a shorter one is summed
afterwards. Hot words are told by ``SLOTS`` counters over the hashes of a sample's words: of fixed
size, whatever the input, and if other words share a hot one's counter they are only dealt out
more finely. The sample only deals out work: the result is the same whatever it finds.

A bucket holds about ``BUCKET`` projections. Arithmetic is decimal: exact for numbers of
occurrences below 10**15.

Defined cases: a null text has no words, a null lang is ``und``; empty pieces have no
words; repeated rows count each; equal score and number go by the phrase in byte order; an empty
table gives no rows; further columns are ignored. A text is split whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import WordHashes, materialize, mix64, small_batches

MAX_WORDS = 3
LEAST = 10
TOP = 2000
#: A phrase goes if a longer one has this percentage of its occurrences or more.
COVERED = 50
BUCKET = 250_000
#: Counters that tell hot words, and the share of rows that they and the number of buckets are estimated from.
SLOTS = 1 << 18
SAMPLE = 0.02
#: Words of a language, and distinct words, after which a task hands on what it has.
FLUSH, DISTINCT = 2_000_000, 1 << 20
#: What ends a piece; what remains between words is the space alone.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
COUNTED = "lang string, phrase string, size int, f long"


def tokens(text: str | None, most: int = 1 << 24) -> Iterator[list[bytes]]:
    """Words with A-Z lower-cased, a line end between pieces, and empty bytes, which are no words.

    A text of more than ``most`` bytes comes in lists of about as many, cut where a piece ends.
    """
    data = text.encode().lower().translate(_ENDS) if text else b""
    begin = 0
    while begin < len(data):
        end = data.find(b"\n", begin + most)
        end = len(data) if end < 0 else end + 1
        yield data[begin:end].replace(b"\n", b" \n ").split(b" ")
        begin = end


class Ids(dict):
    """word -> number from 1; 0 ends a piece, -1 is no word."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) - 1
        return value


def slots(lang: str, hashes: np.ndarray) -> np.ndarray:
    """The counter of each word, by its hash."""
    return (mix64(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) % np.uint64(SLOTS)).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, found = WordHashes(), np.zeros(SLOTS, np.int64)
    for batch in batches:
        parts = [(lang, part) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for part in tokens(text)]
        here = [slots(lang, known.of([w for w in part if w and w != b"\n"])) for lang, part in parts]
        found += np.bincount(np.concatenate(here or [np.empty(0, np.int64)]), minlength=SLOTS)
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["slot", "n"])


def hot_slots(docs: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """(for each counter, whether its words have more than about ``most`` occurrences; about how many words all texts have)."""
    found = docs.sample(SAMPLE, seed=12).mapInArrow(_sampled, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = materialize(found, "sampled")  # SLOTS rows at most
    hot = np.zeros(SLOTS, bool)
    hot[[r[0] for r in found.where(F.col("n") >= most * SAMPLE).select("slot").collect()]] = True
    return hot, int((found.agg(F.sum("n")).first()[0] or 0) / SAMPLE)


def _project(hot: np.ndarray, buckets: int, max_words: int, flush: int):
    def blocks(held: dict[str, list[np.ndarray]], ids: Ids, rng: np.random.Generator) -> Iterator[tuple]:
        words = list(ids)[2:]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        bits = max(1, int(len(words)).bit_length())
        for lang, parts in held.items():
            row = np.concatenate([*parts, np.zeros(max_words, np.int64)])
            row = row[row >= 0]
            n = len(row) - max_words
            columns = [row[:n]]
            for k in range(1, max_words):
                columns.append(np.where(columns[-1] > 0, row[k : n + k], 0))
            columns = [c[columns[0] > 0] for c in columns]
            # equal projections once, with their number
            if bits * max_words <= 63:
                key = columns[0]
                for c in columns[1:]:
                    key = (key << bits) | c
                key, count = np.unique(key, return_counts=True)
                columns = [(key >> (bits * (max_words - 1 - k))) & ((1 << bits) - 1) for k in range(max_words)]
            else:
                rows, count = np.unique(np.stack(columns), axis=1, return_counts=True)
                columns = list(rows)
            if not len(count):
                continue
            is_hot = np.concatenate([[True], hot[slots(lang, hashes)]])  # the end of a piece tells nothing apart
            where, more = np.full(len(count), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64), np.ones(len(count), bool)
            for c in columns:
                where = np.where(more & (c > 0), mix64(where ^ hashes[np.maximum(c, 1) - 1]) + np.uint64(1), where)
                more &= is_hot[c]
            where[more] = mix64(where[more] ^ np.uint64(rng.integers(1 << 63)))
            where = (where % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            columns, count = [c[order] for c in columns], count[order]
            for b in np.flatnonzero(np.diff(edges)):
                some = slice(edges[b], edges[b + 1])
                block = np.stack([c[some] for c in columns])
                used, block = np.unique(block, return_inverse=True)
                first = int(used[0] == 0)  # 0 stays 0, words count from 1
                block = block.astype(np.uint32) + np.uint32(1 - first)
                yield int(b), lang, b" ".join([words[i - 1] for i in used[first:]]), block.tobytes(), count[some].astype(np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        ids, size, end = Ids(), 0, np.zeros(1, np.int64)
        rng = np.random.default_rng(TaskContext.get().partitionId())

        def told() -> Iterator[pa.RecordBatch]:
            # a few blocks at a time
            rows: list[tuple] = []
            for row in blocks(held, ids, rng):
                rows.append(row)
                if len(rows) == 64:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in tokens(text):
                    held.setdefault(lang, []).extend((np.fromiter(map(ids.__getitem__, found), np.int64, len(found)), end))
                    size += len(found)
                    if size >= flush or len(ids) >= DISTINCT:
                        yield from told()
                        held, ids, size = {}, Ids(), 0
        yield from told()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "lang", "words", "rows", "counts"])

    return run


def grown(columns: list[np.ndarray], count: np.ndarray, least: int, whole: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
    """(phrase as numbers, occurrences), depth-first, from projections in order of all columns.

    A phrase with ``least`` occurrences comes and is extended; one that has others in further
    tasks, as all its words are hot (``whole``: those that are not), comes whatever it has here.
    """
    sums = np.concatenate([[0], np.cumsum(count)])

    def extend(prefix: tuple[int, ...], begin: int, end: int, split: bool) -> Iterator[tuple[tuple[int, ...], int]]:
        column = columns[len(prefix)][begin:end]
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [end - begin]])
        found = sums[begin + edges[1:]] - sums[begin + edges[:-1]]
        heads = column[edges[:-1]]
        keep = (heads > 0) & ((found >= least) | (split & ~whole[heads]))
        for i in np.flatnonzero(keep):
            word = int(heads[i])
            phrase = (*prefix, word)
            yield phrase, int(found[i])
            if len(phrase) < len(columns):
                yield from extend(phrase, begin + int(edges[i]), begin + int(edges[i + 1]), split and not whole[word])

    if len(count):
        yield from extend((), 0, len(count), True)


def _grow(hot: np.ndarray, least: int, max_words: int):
    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        langs = table["lang"].to_pylist()
        for lang in sorted(set(langs)):
            ids, parts, counts = Ids(), [], []
            for i in [i for i, x in enumerate(langs) if x == lang]:
                words, rows = table["words"][i].as_py(), np.frombuffer(table["rows"][i].as_py(), np.uint32)
                mine = np.concatenate([[0], np.fromiter(map(ids.__getitem__, words.split(b" ")), np.int64)])
                parts.append(mine[rows].reshape(max_words, -1))
                counts.append(np.frombuffer(table["counts"][i].as_py(), np.uint32).astype(np.int64))
            block, count = np.concatenate(parts, axis=1), np.concatenate(counts)
            order = np.lexsort(block[::-1])
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, list(ids)[2:]), np.uint64, len(ids) - 2)
            words, whole = [w.decode() for w in ids], np.concatenate([[True], ~hot[slots(lang, hashes)]])
            out.append((lang, "", 0, int(count.sum())))
            for phrase, f in grown([c[order] for c in block], count[order], least, whole):
                out.append((lang, " ".join([words[i + 1] for i in phrase]), len(phrase), f))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lang", "phrase", "size", "f"])

    return run


def phrase_counts(documents: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, bucket: int = BUCKET, flush: int = FLUSH) -> DataFrame:
    """lang, phrase, size (words), f: all phrases with f >= least, and with size 0 the number of all words of each language."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    hot, total = hot_slots(docs, bucket)
    buckets = max(64, -(-total // bucket))
    sent = docs.mapInArrow(_project(hot, buckets, max_words, flush), "bucket long, lang string, words binary, rows binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(_grow(hot, least, max_words), COUNTED)
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(f"size = 0 OR f >= {int(least)}")


def collocations(documents: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two words or more."""
    known = materialize(phrase_counts(documents, least, max_words), "phrases")
    phrases = known.where("size > 0").select("lang", "phrase", "size", "f")
    long = phrases.where("size > 1").withColumnRenamed("f", "a").withColumn("_w", F.split("phrase", " "))
    part = lambda begin, n: F.array_join(F.slice("_w", begin, n), " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("_first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_rest"))
    # each side of a cut has one row in phrases, so a word that many phrases begin with can be split among tasks
    left = phrases.select(F.col("lang").alias("_ll"), F.col("phrase").alias("_lp"), F.col("f").alias("l"))
    right = phrases.select(F.col("lang").alias("_rl"), F.col("phrase").alias("_rp"), F.col("f").alias("r"))
    cuts = cuts.join(left, (F.col("lang") == F.col("_ll")) & (F.col("_first") == F.col("_lp")))
    cuts = cuts.join(right, (F.col("lang") == F.col("_rl")) & (F.col("_rest") == F.col("_rp")))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a")).cast("decimal(38,0)"), (whole("l") * whole("r")).cast("decimal(38,0)"))
    lowest = F.min(F.struct(score.cast("long").alias("score"), F.col("k"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(lowest.alias("_cut"))
    # of the longer phrases around a phrase, the most frequent one
    inner = long.where("size > 2").withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("_at", F.explode(F.expr("sequence(1, size - _n + 1)")))
    around = inner.groupBy(F.col("lang").alias("_al"), part(F.col("_at"), F.col("_n")).alias("_ap")).agg(F.max("a").alias("_longer"))
    kept = scored.join(around, (F.col("lang") == F.col("_al")) & (F.col("phrase") == F.col("_ap")), "left")
    kept = kept.where(f"_longer IS NULL OR 100 * _longer < {int(covered)} * a")
    kept = kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are ranked in 64 shares first, so one that holds most rows isn't ranked in one task
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = kept.withColumn("_rn", F.row_number().over(shares)).where(F.col("_rn") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = known.where("size = 0").select(F.col("lang").alias("_tl"), F.col("f").alias("n"))
    ranked = ranked.join(totals, F.col("lang") == F.col("_tl"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

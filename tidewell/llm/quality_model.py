"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (single tokens and pairs): the target
is fitted on the documents labelled good (quality 1, not toxic) with the raw
model as its prior, the raw model on every document. A document's log importance
weight is the log ratio of both models for all its n-grams, at every length.
Gumbel noise on the log weights and a top-k make that a sample without
replacement by weight.

k follows from the labels, before any noise is drawn: the cutoff on log weights
that best parts labelled good from labelled bad (quality 0) rows, each good row
weighed by a target model without its own fold of the labels, gives k as the number
of documents whose log weight is at or above it. Which k those are, the noisy weights
decide. The k-th largest is found by counting in ever finer bins, so no task sorts or
holds all documents.

Parameters with bounds: ``buckets`` n-gram buckets a model; ``labelled`` labelled
doc_ids at most to fit on, chosen by hash of doc_id, of each its least text. The raw
model's counts cover all documents.

Defined cases: null and empty texts have log weight 0; null and repeated doc_id
are scored row by row, with noise from doc_id and text, so equal rows get equal
results, and all rows that tie with the k-th are kept; without labels of both kinds
every document is kept; an empty table gives no rows; further columns are ignored by
``resample`` and given back by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WordHashes, materialize, mix64, small_batches

BUCKETS = 1 << 13
FOLDS = 5
PRIOR = 10_000
LABELLED = 50_000
SEED = 11
BINS = 4096
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def ngrams(text: str | None, hashes: WordHashes, buckets: int) -> np.ndarray:
    """Bucket of each token (a run of letters and digits, or of signs) and of each pair of neighbours."""
    tokens = _TOKEN.findall(text.encode()) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    one = hashes.of(tokens)
    two = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    return (np.concatenate([mix64(one), two]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = WordHashes(), {}
        for batch in batches:
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fold not in sums:
                    sums[fold] = np.zeros(buckets, np.int64)
                found = ngrams(text, hashes, buckets)
                if len(found) < buckets // 8:
                    np.add.at(sums[fold], found, 1)
                else:
                    sums[fold] += np.bincount(found, minlength=buckets)
        for fold, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(some), pa.int32()), pa.array(some), pa.array(n[some])], ["fold", "bucket", "n"])

    return run


def ngram_counts(documents: DataFrame, folds: int, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all n-grams of documents (fold, text), by fold and bucket: each task sends a row for each, and folds * buckets rows come back."""
    rows = documents.select("fold", "text").mapInArrow(_counts(buckets), "fold int, bucket long, n long")
    out = np.zeros((folds, buckets))
    for fold, bucket, n in rows.groupBy("fold", "bucket").agg(F.sum("n").alias("n")).collect():
        out[fold, bucket] = n
    return out


def _scores(ratios: np.ndarray, seed: int):
    """Batches (doc_id, text, fold, mark): fold -1 is scored with the last row of ratios; mark is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            weights, noise = [], []
            for doc, text, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = ngrams(text, hashes, ratios.shape[1])
                weights.append(float(ratios[fold][found].sum()))
                u = (xxhash.xxh3_64_intdigest(f"{doc}\0{text or ''}", seed=seed) >> 11) + 0.5
                noise.append(float(-np.log(-np.log(u / (1 << 53)))))
            columns = [batch.column(0), batch.column(3), pa.array(weights, pa.float64()), pa.array(noise, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "log_weight", "noise"])

    return run


def cutoff(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight at or above which rows count as good: best mean of both kinds' shares; minus infinity without both kinds.

    Between the two rows that the best cut parts, the cut lies halfway.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    good_below = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    gain = bad_below - good_below
    gain[1:-1][w[1:] == w[:-1]] = -1  # no cut between equals
    k = int(np.argmax(gain))
    return -np.inf if k == 0 else np.inf if k == len(w) else float((w[k - 1] + w[k]) / 2)


def top_k_threshold(scored: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of column: counts in BINS bins, then in finer ones within the bin that holds it."""
    low, high = scored.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    while low < high:
        step = (high - low) / BINS
        place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / step))).cast("int") if step > 0 else F.lit(0)
        inside = scored.where(F.col(column).between(low, high))
        found = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for _, n, lo, hi in found:
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        else:
            return low
        if len(found) == 1 and step <= 0:
            break
    return low


def _mark(doc_id: Column, text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(doc_id.cast("long"), text)


def score_documents(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED, seed: int = SEED) -> tuple[DataFrame, float]:
    """(doc_id, mark, log_weight, noise) of every document, written, and the labelled rows' cutoff."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a doc_id labelled twice counts as its worst label; toxic rows are neither kind
    kind = F.when(F.col("quality") != 1, 0).when(F.coalesce("toxic", F.lit(0)) == 0, 1)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_id"), kind.alias("good")).where("good IS NOT NULL")
    marks = marks.groupBy("_id").agg(F.min("good").alias("good"))
    marks = marks.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int"))
    marks = materialize(marks.orderBy(F.xxhash64("_id", F.lit(seed))).limit(labelled), "marks")
    # ``labelled`` rows of three numbers at most: sent to every task, so that only labelled texts are shuffled
    known = docs.join(F.broadcast(marks), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "good", "fold").agg(F.min("text").alias("text"))
    known = materialize(known, "known")
    raw = ngram_counts(docs.withColumn("fold", F.lit(0)), 1, buckets)[0]
    good = ngram_counts(known.where("good = 1"), FOLDS, buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    model = lambda n: np.log((n + PRIOR * p) / (n.sum() + PRIOR) / p)
    ratios = np.stack([*(model(good.sum(axis=0) - part) for part in good), model(good.sum(axis=0))])
    scores = lambda rows: rows.mapInArrow(_scores(ratios, seed), "doc_id long, mark long, log_weight double, noise double")
    scored = materialize(scores(docs.select("doc_id", "text", F.lit(-1), _mark(F.col("doc_id"), F.col("text")))), "scores")
    # ``labelled`` rows at most
    found = scores(known.select("doc_id", "text", "fold", F.col("good").cast("long"))).select("mark", "log_weight").collect()
    return scored, cutoff(np.array([r[1] for r in found]), np.array([r[0] == 1 for r in found], bool))


def _resampled(documents: DataFrame, labels: DataFrame, k: int | None, seed: int) -> DataFrame:
    scored, cut = score_documents(documents, labels, seed=seed)
    if k is None:
        k = scored.where(F.col("log_weight") >= cut).count()
    scored = scored.select("doc_id", "mark", "log_weight", (F.col("log_weight") + F.col("noise")).alias("key"))
    least = top_k_threshold(scored, "key", k)
    return scored.withColumn("kept", F.col("key") >= least)


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key (log weight with Gumbel noise), kept (among the k largest keys; k by the cutoff if None)."""
    return _resampled(documents, labels, k, seed).drop("mark")


def keep_good(documents: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of documents that resample keeps."""
    gone = _resampled(documents, labels, k, seed).where("NOT kept").select(F.col("doc_id").alias("gone"), "mark").distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _mark(F.col("doc_id"), F.col("text")).alias("own"))
    return rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone")) & (F.col("own") == F.col("mark")), "left_anti").select("row.*")

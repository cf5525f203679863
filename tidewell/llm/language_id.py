"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence about a page's language are multiplied:

* text: likelihoods of hashed byte 4-grams of the visible text, from a model
  fitted on documents with known language;
* the language that the page's markup declares, and the suffix of its address:
  how often each value goes with each language;
* the host: its pages' languages, smoothed by those of its domain, these by
  those of its suffix, and these by those of all pages.

The tables of the last two kinds come from the pages themselves, as grouped sums
of the text's posteriors, less the page's own share, so that a page is no
evidence for itself. Hot hosts and suffixes are sums, one row a task.

Posteriors are summed as whole numbers of 2**-40, so sums don't depend on the order
of rows, and reruns agree to the last digit.

Bounds: the text model is fitted on at most ``LABELLED`` documents, those with the
smallest hash of doc_id, language and text (repeated rows count once, and rows that share an id, or have
none, are drawn each by itself); it has ``BUCKETS`` buckets a language, of which it holds those that occur. Languages are those with at least one such document, so there may be as many.

Defined cases: null or unreadable url, null html and pages without text leave the
other evidence; with none at all, the prior of all pages decides (ties: first
in alphabetical order); repeated rows get the same result each; without labelled
documents the language is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, mix64, small_batches

BUCKETS = 1 << 14
LABELLED = 5_000
#: Text counts as so many independent 4-grams at most: they overlap, and are far from independent.
EVIDENCE = 60.0
#: Pages that a level's prior counts for.
STRENGTH = 4.0
#: One unit of the posteriors' sums.
UNIT = 1 << 40
_OPEN = re.compile(r"(?i)<(?:(script|style|nav|head)\b|!--)?")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav", "head")}


def visible_text(page: str | None) -> str:
    """Text outside of tags, comments, scripts, styles, head and navigation, entities decoded.

    What is opened and never closed hides nothing but its tag. Each kind of end is
    searched for no further once it is known to come no more, so time is linear.
    """
    if not page:
        return ""
    out, at, ended = [], 0, set()

    def end_of(kind: str, begin: int) -> int:
        if kind in ended:
            return -1
        if kind in _CLOSE:
            m = _CLOSE[kind].search(page, begin)
            end = m.end() if m else -1
        else:
            end = page.find(kind, begin) + len(kind)
            end = -1 if end < begin + len(kind) else end
        if end < 0:
            ended.add(kind)
        return end

    while (m := _OPEN.search(page, at)) is not None:
        out.append(page[at : m.start()])
        kind = m[1].lower() if m[1] else "-->" if m[0] == "<!--" else None
        end = end_of(kind, m.end()) if kind else -1
        if end < 0:
            end = end_of(">", m.start() + 1)
        if end < 0:  # no further tag can end
            out[-1] += page[m.start() :]
            break
        at = end
    else:
        out.append(page[at:])
    return html_lib.unescape(" ".join(out))


def grams(text: str) -> np.ndarray:
    """Bucket of each byte 4-gram of the lower-cased text, runs of other than letters as one space."""
    data = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode(), np.uint8).astype(np.uint64)
    if len(data) < 4:
        return np.empty(0, np.int64)
    n = len(data) - 3
    word = data[:n] | data[1 : n + 1] << np.uint64(8) | data[2 : n + 2] << np.uint64(16) | data[3 : n + 3] << np.uint64(24)
    return (mix64(word) % np.uint64(BUCKETS)).astype(np.int64)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang] += np.bincount(grams(text or ""), minlength=BUCKETS)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "bucket", "n"])


def fit_text_model(documents: DataFrame, labelled: int = LABELLED) -> tuple[list[str], TextModel]:
    """(languages, their model) from documents (doc_id, text, lang)."""
    small_batches(documents.sparkSession)
    known = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("_h"))
    # of repeated rows, which share a hash, one counts
    last = known.select("_h").distinct().orderBy("_h").limit(labelled).agg(F.max("_h")).first()[0]
    chosen = known.where(F.col("_h") <= F.lit(last)).groupBy("_h").agg(F.first(F.struct("lang", "text")).alias("_row")).select("_row.*")
    rows = chosen.mapInArrow(_gram_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    bucket = np.array([r["bucket"] for r in rows], np.int64)
    order = np.argsort(bucket, kind="stable")
    lang = np.array([place[r["lang"]] for r in rows], np.int64)[order]
    n = np.array([r["n"] for r in rows], float)[order]
    total = np.bincount(lang, weights=n, minlength=len(langs)) + 0.5 * BUCKETS
    return langs, TextModel(
        start=np.searchsorted(bucket[order], np.arange(BUCKETS + 1)), lang=lang, more=np.log((n + 0.5) / 0.5), least=np.log(0.5 / total)
    )


@dataclass(frozen=True)
class TextModel:
    """Log likelihoods by language: ``least`` for any bucket, and ``more`` for those that occur (bucket b's from start[b] to start[b + 1])."""

    start: np.ndarray
    lang: np.ndarray
    more: np.ndarray
    least: np.ndarray

    def log_likelihood(self, found: np.ndarray) -> np.ndarray:
        bucket, times = np.unique(found, return_counts=True)
        size = self.start[bucket + 1] - self.start[bucket]
        # the places of all found buckets' entries, side by side
        at = np.arange(size.sum()) + np.repeat(self.start[bucket] - np.cumsum(size) + size, size)
        weights = self.more[at] * np.repeat(times, size)
        return self.least * len(found) + np.bincount(self.lang[at], weights=weights, minlength=len(self.least))


def _texts(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(1).to_pylist():
                found = grams(visible_text(page))
                weight = min(1.0, EVIDENCE / max(1, len(found)))
                ll = model.log_likelihood(found) * weight
                out.append(ll - ll.max() if len(ll) else ll)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))],
                ["page_id", "declared", "host", "domain", "suffix", "text_ll"],
            )

    return run


def address(url: Column) -> dict[str, Column]:
    """Host, domain (its last two labels) and suffix (its last label) of an address; empty where it can't be read."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract(host, r"([^.]+)$", 1)}


def declared_language(page: Column) -> Column:
    """Primary language tag of the page's html element, lower case, empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,8})""", 1))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _softmax(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x))
    return F.transform(ll, lambda x: F.exp(x) / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host: one row for each row of pages."""
    spark = pages.sparkSession
    langs, model = fit_text_model(documents)
    k = len(langs)
    if not k:
        nothing = {c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("confidence", "double"), ("text_lang", "string"))}
        return pages.select("page_id", *[c.alias(n) for n, c in nothing.items()], declared_language(F.col("html")).alias("declared"), address(F.col("url"))["host"].alias("host"))
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", declared_language(F.col("html")).alias("declared"), *[c.alias(n) for n, c in address(F.col("url")).items()])
    schema = "page_id long, declared string, host string, domain string, suffix string, text_ll array<double>"
    scored = rows.mapInArrow(_texts(model), schema).withColumn("p", F.transform(_softmax(F.col("text_ll")), lambda x: F.round(x * UNIT).cast("long")))
    scored = materialize(scored, "pages")

    def sums(*by: str) -> DataFrame:
        """Sum of the pages' posteriors for each value, an array by language."""
        # decimals: a long would pass its range beyond eight million pages
        total = scored.groupBy(*by).agg(*[F.sum(F.col("p")[i].cast("decimal(15,0)")).alias(f"s{i}") for i in range(k)])
        return total.select(*[F.col(c).alias(f"_{c}") for c in by], F.array(*[F.col(f"s{i}") for i in range(k)]).alias("_" + "_".join(by) + "_n"))

    whole = sums().first()
    whole = list(whole[0]) if whole and whole[0] and whole[0][0] is not None else [0] * k
    out = scored
    for by in ("host", "domain", "suffix", "declared"):
        # a page belongs to one value of each; hot values are split among tasks by the join
        out = out.join(materialize(sums(by), by), F.col(by) == F.col(f"_{by}")).drop(f"_{by}")
        out = materialize(out, f"with_{by}") if by == "host" else out
    base = F.array(*[F.lit(x) for x in whole])
    less = lambda n: F.zip_with(n, F.col("p"), lambda x, own: (x - own).cast("double") / UNIT)
    total = lambda n: F.aggregate(n, F.lit(0.0), lambda s, x: s + x)

    def smoothed(n: Column, prior: Column) -> Column:
        return F.zip_with(n, prior, lambda x, q: (x + STRENGTH * q) / (total(n) + STRENGTH))

    out = out.withColumn("_all", less(base)).withColumn("_prior", F.transform("_all", lambda x: (x + 1.0) / (total(F.col("_all")) + k)))
    for by in ("suffix", "domain", "host"):
        out = out.withColumn(f"_{by}_n", less(F.col(f"_{by}_n")))
        out = out.withColumn("_prior", F.when(F.col(by) != "", smoothed(F.col(f"_{by}_n"), F.col("_prior"))).otherwise(F.col("_prior")))
    # how likely each language is to carry this declaration: its pages with it, over all its pages
    out = out.withColumn("_declared_n", less(F.col("_declared_n")))
    said = F.zip_with("_declared_n", "_all", lambda x, a: F.log((x + 0.5) / (a + 1.0)))
    fused = F.zip_with(_add(F.col("text_ll"), F.transform("_prior", lambda x: F.log(x))), F.when(F.col("declared") != "", said).otherwise(F.array(*[F.lit(0.0)] * k)), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    out = out.withColumn("_fused", fused).withColumn("_fused", F.transform("_fused", lambda x: x - F.array_max("_fused")))
    return out.select(
        "page_id", best(F.col("_fused")).alias("lang"), F.array_max(_softmax(F.col("_fused"))).alias("confidence"),
        best(F.col("text_ll")).alias("text_lang"), "declared", "host",
    )

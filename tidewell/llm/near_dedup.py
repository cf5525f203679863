"""Near-duplicate classes by min-max hashing, with every link confirmed on full shingle sets.

Each text becomes its set of distinct 5-word shingles. A permutation gives both
its minimum and its maximum over the set, so half as many hash evaluations fill
a signature; bands of five values find candidates.

Cost of a miss: two texts at the threshold (Jaccard 0.85, or ``percent``) share one given band
with probability 0.85**5 = 0.44, and fewer than two of the 30 bands with less than 1e-6.
Every pair that shares two bands is held together, in buckets of all sizes, so a link at
the threshold is missed with less than that and one above it with less still. For a
lower threshold bands are added until that holds again: 44 for 0.80.

How large groups stay small work:

1. Texts with equal shingle sets are one class, which a number (its node) stands
   for, with the text of its smallest doc_id; only nodes go on.
2. A star round: each node is held against one pivot of the buckets it shares,
   not against the whole bucket. The pivot of a bucket is the node that meets
   most others in all its buckets: of a group of copies, the original, which
   differs least from each. Confirmed links give components.
3. Only buckets that still hold nodes of different components go on. There,
   pairs of different components are confirmed too, if their sizes and longer
   signatures (``FINE`` values, made for these nodes only) allow the threshold. A
   pair is told apart once, in the smallest of the buckets it shares. A bucket over
   ``BLOCK`` nodes is dealt by each second band that its nodes share, and
   what is still larger is compared in blocks of ``BLOCK``.

Defined cases: null or blank texts have an empty set and are linked with
nothing; texts under five words are one shingle; rows with a null doc_id have
component null and are kept; an empty table gives no rows. ``near_duplicates``:
repeated rows get the same result each; one doc_id with several texts stands for
all of them; further columns are ignored. ``keep_one``: rows of one doc_id with
unlike texts are judged each by its own text, of equal rows one stays (any, where only further
columns differ), further columns are given back whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WordHashes, ascii_lower_words, materialize, mix64, small_batches

SHINGLE = 5
PERCENT = 85
BANDS = 30
ROWS = 5
#: Each permutation gives two of a signature's values.
PERMUTATIONS = BANDS * ROWS // 2
#: Values of the longer signature, one byte each, and how many of them must agree before a pair
#: is confirmed on full sets: at the threshold 436 are expected, with a deviation of 8.
FINE = 512
AGREE = 395
BLOCK = 1024
CHUNK = 32

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_FINE_MULTIPLY = _rng.integers(0, 1 << 63, FINE // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_ADD = _rng.integers(0, 1 << 63, FINE // 2, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For thresholds below PERCENT further bands follow, up to as many.
_MORE = 1000
_MULTIPLY = np.concatenate([_MULTIPLY, _rng.integers(0, 1 << 63, _MORE * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
_ADD = np.concatenate([_ADD, _rng.integers(0, 1 << 63, _MORE * ROWS // 2, dtype=np.uint64)])
_BAND = np.concatenate([_BAND, _rng.integers(0, 1 << 63, (_MORE, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])


def bands_for(percent: int) -> int:
    """An even number of bands, BANDS or more, of which a pair at the threshold shares fewer than two with a chance of less than a millionth."""
    p = (percent / 100) ** ROWS
    for bands in range(BANDS, BANDS + _MORE + 1, 2):
        if (1 - p) ** (bands - 1) * (1 - p + bands * p) < 1e-6:
            return bands
    raise ValueError(f"no bands for a threshold of {percent} %")


def agree_for(percent: int) -> int:
    """How many of the FINE values must agree: as many deviations below what is expected as AGREE lies below it at PERCENT."""
    mean = lambda p: FINE * p / 100
    spread = lambda p: math.sqrt(FINE * p * (100 - p)) / 100
    return AGREE if percent == PERCENT else math.floor(mean(percent) - (mean(PERCENT) - AGREE) / spread(PERCENT) * spread(percent))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = ascii_lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = hashes.of(words)
    n = len(h) - SHINGLE + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += mix64(h[k : k + n]) * _PLACE[k]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray, multiply: np.ndarray = _MULTIPLY[:PERMUTATIONS], add: np.ndarray = _ADD[:PERMUTATIONS]) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    out = np.empty((len(multiply), 2), np.uint64)
    step = max(1, 60_000 // len(shingles))
    for i in range(0, len(multiply), step):
        # a multiply-add permutes the 64-bit numbers; what it orders is well mixed already
        x = multiply[i : i + step, None] * shingles + add[i : i + step, None]
        out[i : i + step, 0], out[i : i + step, 1] = x.min(axis=1), x.max(axis=1)
    return out.ravel()


def _deal(sig: np.ndarray) -> np.ndarray:
    """Band by row: a band takes values of different permutations."""
    return sig.reshape(-1, 2).T.reshape(-1, ROWS)


def _signed(batches: Iterator[pa.RecordBatch], n_bands: int = BANDS) -> Iterator[pa.RecordBatch]:
    hashes, known = WordHashes(), {}
    multiply, add = _MULTIPLY[: n_bands * ROWS // 2], _ADD[: n_bands * ROWS // 2]
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            key = xxhash.xxh3_128_digest(text.encode()) if text else b""
            row = known.get(key)
            if row is None:
                s = shingle_set(text, hashes)
                if len(s):
                    sig = signature(s, multiply, add)
                    bands = mix64((mix64(_deal(sig)) * _BAND[:n_bands]).sum(axis=1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64))
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    row = (len(s), digest, bands.view(np.int64))
                else:
                    row = (0, None, None)
                if len(known) > 2000:
                    known.clear()
                known[key] = row
            rows.append(row)
        n, digest, bands = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["doc_id", "th", "n", "digest", "bands"],
        )


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, comp, small, large, text) -> the same with n, sig in place of text: a byte of each value of the longer signature."""
    hashes = WordHashes()
    for batch in batches:
        n, sig = [], []
        for text in batch.column(4).to_pylist():
            s = shingle_set(text, hashes)
            n.append(len(s))
            sig.append((mix64(signature(s, _FINE_MULTIPLY, _FINE_ADD)) >> np.uint64(56)).astype(np.uint8).tobytes())
        columns = [*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(sig, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "comp", "small", "large", "n", "sig"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (a, chunk, role, b, text) in that order: a head (role 0) is followed by those to hold against it."""
    hashes, head, heads = WordHashes(), None, []
    for batch in batches:
        a, chunk, role, b, text = (batch.column(i).to_pylist() for i in range(5))
        left, right = [], []
        for i in range(len(a)):
            if role[i] == 0:
                if head != (a[i], chunk[i]):
                    head, heads = (a[i], chunk[i]), []
                heads.append(shingle_set(text[i], hashes))
                continue
            if head != (a[i], chunk[i]):
                continue
            s = shingle_set(text[i], hashes)
            for h in heads:
                if _alike(h, s, percent):
                    left.append(a[i])
                    right.append(b[i])
                    break
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets reach the threshold.

    A node with many partners is sent once for each CHUNK of them.
    """
    chunks = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(chunks, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).cast("int").alias("chunk"), F.lit(1).alias("role"), "b"
    )
    dealt = materialize(dealt, "dealt")  # read twice
    heads = dealt.select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b")).distinct()
    rows = dealt.unionByName(heads)
    named = texts.withColumnRenamed("node", "_id")
    rows = rows.join(named, rows["b"] == named["_id"]).select("a", "chunk", "role", "b", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return rows.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long").distinct()


def _close(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, key, other, node, comp, n, small, large, sig) in order of group: pairs of different components that may be linked.

    block is -1 for rows that meet all of their group; else a group's rows of
    block 0 meet those of block 1 only. A pair is given out once: under the
    first small bucket that it shares, else under its first two large ones.
    """
    group, held, agree = None, [], agree_for(percent)

    def is_first(i: int, j: int) -> bool:
        key, other = held[0][1:3]
        shared = held[i][6] & held[j][6]
        if other is None:
            return min(shared) == key
        return not shared and sorted(held[i][7] & held[j][7])[:2] == [key, other]

    def pairs() -> tuple[list, list]:
        if len(held) < 2:
            return [], []
        block, node, comp, n = (np.array([r[i] for r in held], np.int64) for i in (0, 3, 4, 5))
        sig = np.frombuffer(b"".join(r[8] for r in held), np.uint8).reshape(len(held), -1)
        left, right = [], []
        for i in range(len(held) - 1):
            rest = slice(i + 1, None)
            ok = (comp[rest] != comp[i]) & ((block[rest] != block[i]) | (block[i] < 0))
            ok &= 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
            near = np.flatnonzero(ok)
            if len(near):
                near = near[(sig[i + 1 + near] == sig[i]).sum(axis=1) >= agree] + i + 1
                near = [j for j in near if is_first(i, j)]
                left += [min(node[i], node[j]) for j in near]
                right += [max(node[i], node[j]) for j in near]
        return left, right

    def batch_of(left: list, right: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    for batch in batches:
        left, right = [], []
        for g, *row in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
            if g != group:
                x, y = pairs()
                left += x
                right += y
                group, held = g, []
            row[6:8] = set(row[6]), set(row[7])
            held.append(row)
        yield batch_of(left, right)
    yield batch_of(*pairs())


def _candidates(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """rows (key, node, comp) of buckets -> pairs of different components that may be linked, each once."""
    mixed = [F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    size = rows.groupBy("key").agg(*mixed).where("lo <> hi").select("key", "c")
    rows = materialize(rows.join(size, "key"), "mixed")
    small = F.col("c") <= BLOCK
    key_if = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("key"))))
    nodes = rows.groupBy("node", "comp").agg(key_if(small).alias("small"), key_if(~small).alias("large"))
    named = texts.withColumnRenamed("node", "_id")
    nodes = nodes.join(named, nodes["node"] == named["_id"]).select("node", "comp", "small", "large", "text")
    fine = materialize(nodes.mapInArrow(_fine, "node long, comp long, small array<long>, large array<long>, n long, sig binary"), "fine")
    columns = ["node", "comp", "n", "small", "large", "sig"]
    plain = rows.where(small).select("key", F.col("node").alias("_node")).join(fine, F.col("_node") == F.col("node"))
    plain = plain.select(F.col("key").alias("g"), F.lit(-1).alias("block"), "key", F.lit(None).cast("long").alias("other"), *columns)
    # larger buckets: by a second one that both share
    big = rows.where(~small).select("key", "node", "comp")
    twice = big.join(big.select("node", F.col("key").alias("other")), "node").where("key < other")
    size = twice.groupBy("key", "other").agg(*mixed).where("lo <> hi").select("key", "other", "c")
    # blocks: each row goes to the pairs of blocks that its block is part of
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(
            F.xxhash64(F.col("key"), F.col("other"), F.least(k, mine), F.greatest(k, mine)).alias("g"),
            F.when(k == mine, F.lit(-1)).when(mine < k, F.lit(0)).otherwise(F.lit(1)).alias("block"),
        ),
    )
    dealt = twice.join(size, ["key", "other"]).select(F.explode(cells).alias("cell"), "key", "other", F.col("node").alias("_node"))
    dealt = dealt.join(fine, F.col("_node") == F.col("node")).select("cell.g", "cell.block", "key", "other", *columns)
    both = plain.unionByName(dealt).repartition("g").sortWithinPartitions("g")
    return both.mapInArrow(lambda batches: _close(batches, percent), "a long, b long").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, comp: the smallest node reachable, for every node with a link.

    Alternates large-star and small-star steps until nothing changes; every
    step is a grouped minimum and a join, and is written to the shared folder.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots).distinct()


def _linked(documents: DataFrame, percent: int, by_doc_id: bool) -> tuple[DataFrame, DataFrame]:
    """(signed, many): every row's doc_id, th (its text's hash), n; and, for the rows (doc_id, th) that aren't the
    first of their component, the first (by doc_id, then th) as rep."""
    n_bands = bands_for(percent)
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = docs.mapInArrow(lambda batches: _signed(batches, n_bands), "doc_id long, th long, n long, digest binary, bands array<long>")
    signed = materialize(signed, "signed")
    linkable = signed.where("n > 0 AND doc_id IS NOT NULL")
    narrow = linkable.select("doc_id", "th", "digest")
    classes = materialize(narrow.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("first")).select("digest", "first.*"), "firsts")
    # numbered in order of doc_id: among equals, the earlier text becomes the pivot, which is the likelier original
    classes = classes.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = linkable.join(classes, ["digest", "doc_id", "th"]).select("node", "bands").distinct()

    banded = materialize(nodes.select("node", F.explode("bands").alias("key")), "banded")
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    banded = materialize(banded.join(shared, "key"), "shared")
    nearby = materialize(banded.groupBy("node").agg(F.sum("c").alias("met")), "nearby")
    firsts = classes.join(nearby, "node").select("node", F.col("doc_id").alias("_doc"), F.col("th").alias("_th"))
    found = docs.join(firsts, (F.col("doc_id") == F.col("_doc")) & (F.col("th") == F.col("_th")))
    texts = materialize(found.groupBy("doc_id", "th", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts")

    met = banded.select("key", "node").join(nearby, "node")
    pivots = met.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("by"), "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    together = banded.join(pivots, "key").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("c"))
    best = together.groupBy("node").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("best"))
    tested = materialize(best.select((-F.col("best.p")).alias("a"), F.col("node").alias("b")), "pairs")
    links = materialize(_confirmed(tested, texts, percent), "links")
    comp = _assign(nearby, links)

    pairs = _candidates(banded.select("key", "node").join(comp, "node"), texts, percent)
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    more = materialize(_confirmed(pairs, texts, percent), "links")
    of_class = narrow.join(classes.select("node", "digest"), "digest").select("doc_id", "th", "node").distinct()
    if by_doc_id:  # texts of one doc_id belong together
        several = of_class.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_max")).where("a <> _max").select("doc_id", "a")
        more = materialize(more.unionByName(of_class.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")), "links")
    if not more.isEmpty():
        comp = _assign(nearby.select("node").unionByName(more.select(F.col("a").alias("node"))).unionByName(more.select(F.col("b").alias("node"))).distinct(), links.unionByName(more))

    # classes of one row and without links need no join
    least = classes.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.struct("doc_id", "th").alias("first"))
    reps = least.join(least.groupBy("comp").agg(F.min("first").alias("rep")), "comp").select("node", "rep")
    many = of_class.join(reps, "node").where("doc_id <> rep.doc_id OR th <> rep.th").select("doc_id", "th", "rep")
    return signed.select("doc_id", "th", "n"), many


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of documents; texts are linked from a Jaccard of percent / 100."""
    signed, many = _linked(documents, percent, by_doc_id=True)
    many = many.where("doc_id <> rep.doc_id").groupBy(F.col("doc_id").alias("_id")).agg(F.min("rep.doc_id").alias("comp"))
    out = signed.join(many, F.col("doc_id") == F.col("_id"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _assign(nodes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links)
    return materialize(nodes.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "comp")


def keep_one(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents without near duplicates: of each component of texts the row of the smallest doc_id (rows with a null doc_id stay)."""
    signed, many = _linked(documents, percent, by_doc_id=False)
    gone = many.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    rest = rows.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("th") == F.col("_th")), "left_anti")
    repeated = signed.where("doc_id IS NOT NULL").groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1")
    if not repeated.isEmpty():
        rest = rest.where("doc_id IS NULL").unionByName(rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "th"]))
    return rest.select("row.*")

"""Hard negatives of anchors, by a Voronoi-partitioned exact join of nearest neighbours.

A row's score for an anchor is the inner product of their whole-number vectors.

1. Norms are augmented: with M the greatest norm, a row o gets the coordinate
   sqrt(M*M - |o|*|o|), so all rows lie on a sphere of radius M, and an anchor q gets 0.
   Inner products stay as they are, and the nearer an augmented row, the higher its score.
2. Up to ``PIVOTS`` rows (those with the smallest hash of vec_id) are pivots. Each row
   belongs to the Voronoi cell of its nearest pivot; its angle to the pivot is kept.
3. An anchor's k-th best score among the pivots is a bound on its k-th best among all
   rows. Angles on a sphere obey the triangle inequality, so a row whose angle to its pivot
   is less than (angle of anchor and pivot) - arccos(bound / (|q| M)) can't reach the bound.
   For each anchor group (anchors of near cells) and cell, the least such angle over the group's
   anchors is the partition bound: rows of the cell beyond it are replicated to the group, others not.
4. Each group joins locally and exactly: inner products as matrices, ties by vec_id.
   A group holds ``ANCHORS`` anchors at most, cells with more are cut; the rows sent to it are
   cut into shares of about ``ROWS``, to each of which the group's anchors go. The shares'
   best are merged by a window of k rows a share.

The join runs twice: for positives (same label; anchors are grouped by a hash of the label too, so
a row meets only anchors that may share its label), and for negatives, whose windows of
scores follow from the positives' scores.

Bounds: PIVOTS vectors and PIVOTS * PIVOTS * LABELS numbers are broadcast at most, whatever the
input. Where a table has no structure, bounds prune little, and a row goes to each group:
then work grows with anchors times rows, which is what an exact answer takes.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite
component, take no part, nor do vectors whose own score passes 2**62 (all others' scores are exact);
shorter vectors count as ending in zeros; rows alike in vec_id and score count once
for an anchor, and a row with the anchor's vec_id is never its positive; repeated anchors count once,
anchors that differ under one vec_id each get their rows; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import materialize

SCALE = 256
PIVOTS = 256
#: Groups of labels that positives are searched in.
LABELS = 16
ANCHORS = 4096
ROWS = 16384
LEAST, MOST = -(1 << 62), 1 << 62
#: Added to angles before a row is left out: far above their rounding.
SLACK = 1e-6
POSITIVES, NEGATIVES = 5, 3
PLACED = "vec_id long, label long, vec array<int>, cell int, angle double"
ANCHOR = "a long, vec_id long, label long, vec array<int>"
FOUND = "a long, w int, vec_id long, score long"


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows of equal width, shorter ones ending in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(max(sizes.max(initial=0), width or 0))
    if len(values) == len(sizes) * width:
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), kind))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floats while all fit 53 bits, else in 64-bit numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if reach < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, vectors as whole numbers."""
    for batch in batches:
        column = batch.column(2)
        sizes = np.diff(column.offsets.to_numpy())
        x = column.flatten()
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(SCALE * x.to_numpy(zero_copy_only=False).astype(np.float64))  # nulls are NaN
            small = np.abs(values) < 2.0**31
        row = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.bincount(row, weights=~small, minlength=len(sizes)) == 0
        values = np.where(small, values, 0).astype(np.int64)
        norm = np.bincount(row, weights=values.astype(float) ** 2, minlength=len(sizes))
        keep &= norm < MOST
        ints = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ints, pa.array(norm)], ["vec_id", "label", "vec", "norm"]).filter(pa.array(keep))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vec, norm (squared) of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return rows.mapInArrow(_whole, "vec_id long, label long, vec array<int>, norm double")


class Sphere:
    """Pivots on the sphere of radius M, and angles to them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, greatest: float):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.radius = np.sqrt(greatest)
        v = vectors.astype(np.float64)
        self.lift = np.sqrt(np.maximum(0.0, greatest - (v * v).sum(1)))

    def angles(self, vectors: np.ndarray, lifted: bool) -> np.ndarray:
        """Of each vector to each pivot; rows are lifted to the sphere, anchors are not."""
        v = vectors.astype(np.float64)
        norm2 = (v * v).sum(1)
        width = max(v.shape[1], self.vectors.shape[1])
        a, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, self.vectors.astype(np.float64)))
        dot = a @ p.T
        length = np.sqrt(norm2)
        if lifted:
            dot = dot + np.sqrt(np.maximum(0.0, self.radius**2 - norm2))[:, None] * self.lift
            length = np.full(len(v), self.radius)
        scale = length[:, None] * self.radius
        return np.arccos(np.clip(np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0), -1.0, 1.0))


def _place(sphere: Sphere):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = sphere.angles(matrix(batch.column(2)), True)
            cell = angles.argmin(1).astype(np.int32)
            found = [pa.array(cell), pa.array(angles[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], ["vec_id", "label", "vec", "cell", "angle"])

    return run


def placed(embeddings: DataFrame) -> tuple[DataFrame, Sphere]:
    """(rows with their cell and angle, written; the pivots)."""
    whole = whole_vectors(embeddings)
    greatest = whole.agg(F.max("norm")).first()[0] or 0.0
    chosen = whole.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "label", "vec").limit(PIVOTS).select("vec_id", "label", "vec").toArrow()
    sphere = Sphere(chosen.column(0).to_numpy(), chosen.column(1).to_numpy(), matrix(chosen.column(2)), greatest)
    if not len(sphere.ids):
        return embeddings.sparkSession.createDataFrame([], PLACED), sphere
    return materialize(whole.select("vec_id", "label", "vec").mapInArrow(_place(sphere), PLACED), "placed"), sphere


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, then vec_id; of places alike in both, one."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        # ties at the floor stay, and repeats of what lies above it may want more
        at = np.flatnonzero(score >= floor)
        order = at[np.lexsort((ids[at], -score[at]))]
        first = np.concatenate([[True], (np.diff(score[order]) != 0) | (np.diff(ids[order]) != 0)])
        if first.sum() >= k:
            return order[first][:k]
    order = np.lexsort((ids, -score))
    if not len(order):
        return order
    first = np.concatenate([[True], (np.diff(score[order]) != 0) | (np.diff(ids[order]) != 0)])
    return order[first][:k]


def windows_found(anchors: pa.Table, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, k: int) -> Iterator[tuple]:
    """(place of the anchor, window, places of its rows, scores): the k best of each window of each anchor.

    anchors: vec_id, label, vec, lo and hi (lists, a window each). Rows of the same label without
    the anchor's vec_id, or rows of other labels.
    """
    a_ids, a_labels, a_vectors = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vec"])
    lows, highs = anchors["lo"].to_pylist(), anchors["hi"].to_pylist()
    for label in np.unique(a_labels):
        mine = np.flatnonzero(labels == label if same else labels != label)
        if not len(mine):
            continue
        some_ids, some = ids[mine], vectors[mine]
        at = np.flatnonzero(a_labels == label)
        for begin in range(0, len(at), 256):
            block = at[begin : begin + 256]
            for i, row in zip(block, scores(a_vectors[block], some), strict=True):
                for w, (lo, hi) in enumerate(zip(lows[i], highs[i], strict=True)):
                    inside = np.flatnonzero((row >= lo) & (row <= hi))
                    if same:
                        inside = inside[some_ids[inside] != a_ids[i]]
                    chosen = inside[best(row[inside], some_ids[inside], k)]
                    if len(chosen):
                        yield i, w, mine[chosen], row[chosen].astype(np.int64)


def _bounded(sphere: Sphere, same: bool, k: int):
    """Raise each window's low end to its k-th best score among the pivots; ``cells``: the anchor's angles to all pivots less its reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ANCHOR.split(", ")]
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            lows = [list(x) for x in table["lo"].to_pylist()]
            for i, w, at, found in windows_found(table, sphere.ids, sphere.labels, sphere.vectors, same, k):
                if len(at) == k:
                    lows[i][w] = max(lows[i][w], int(found[-1]))
            vectors = matrix(batch.column(3))
            angles = sphere.angles(vectors, False)
            reach = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)) * sphere.radius
            least = np.array([min(x, default=MOST) for x in lows], float)
            # all rows may serve a bound that no angle can tell apart
            widest = np.arccos(np.clip(np.divide(least, reach, out=np.full(len(least), -1.0), where=reach > 0), -1.0, 1.0))
            gaps = np.where(least[:, None] > -reach[:, None], angles - widest[:, None], -np.inf) - SLACK
            home = pa.array(angles.argmin(1).astype(np.int32))
            columns = [*(batch.column(n) for n in names), pa.array(lows, pa.list_(pa.int64())), batch.column("hi"), home, lists(gaps, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lo", "hi", "home", "gaps"])

    return run


def anchor_groups(counts: list[tuple[int, int, int]], sphere: Sphere) -> pd.DataFrame:
    """counts: (bucket, home cell, anchors) -> bucket, home, grp, chunks: cells that follow each other from nearest to nearest share a group of ANCHORS at most."""
    v = sphere.vectors.astype(np.float64)
    left, chain = set(range(1, len(v))), [0]
    while left:  # PIVOTS steps
        rest = np.array(sorted(left))
        chain.append(int(rest[((v[rest] - v[chain[-1]]) ** 2).sum(1).argmin()]))
        left.discard(chain[-1])
    place = {cell: i for i, cell in enumerate(chain)}
    out, grp, held, last = [], -1, 0, None
    for bucket, home, n in sorted(counts, key=lambda x: (x[0], place[x[1]])):
        if grp < 0 or bucket != last or held + n > ANCHORS:
            grp, held, last = grp + 1, 0, bucket
        held += n
        out.append((bucket, home, grp, max(1, -(-n // ANCHORS))))
    return pd.DataFrame(out, columns=["bucket", "home", "grp", "chunks"])


def _local(same: bool, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(anchors) and len(rows):
            keys, ids = anchors["a"].to_numpy(), rows["vec_id"].to_numpy()
            for i, w, at, found in windows_found(anchors, ids, rows["label"].to_numpy(), matrix(rows["vec"]), same, k):
                for column, x in zip(out, (np.full(len(at), keys[i]), np.full(len(at), w), ids[at], found), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        flat = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), kind) for x, kind in zip(out, kinds, strict=True)]
        return pa.Table.from_arrays(flat, ["a", "w", "vec_id", "score"])

    return run


def window_join(anchors: DataFrame, rows: DataFrame, sphere: Sphere, same: bool, k: int, per_share: int = ROWS) -> DataFrame:
    """a, w, vec_id, score: for each window of each anchor the k best rows with lo <= score <= hi.

    anchors: a (its own number), vec_id, label, vec, lo, hi (arrays of long, one place a window);
    rows and sphere: see placed. same: rows of the anchor's label with another vec_id, else rows of other labels.
    """
    spark = anchors.sparkSession
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int") if same else F.lit(0)
    schema = ANCHOR + ", lo array<long>, hi array<long>, home int, gaps array<double>"
    known = materialize(anchors.select("a", "vec_id", "label", "vec", "lo", "hi").mapInArrow(_bounded(sphere, same, k), schema).withColumn("bucket", bucket), "anchors")
    # LABELS * PIVOTS rows at most
    counts = [tuple(r) for r in known.groupBy("bucket", "home").count().collect()]
    if not counts:
        return spark.createDataFrame([], FOUND)
    groups = F.broadcast(spark.createDataFrame(anchor_groups(counts, sphere), "bucket int, home int, grp int, chunks int"))
    known = known.join(groups, ["bucket", "home"])
    chunks = known.groupBy("grp").agg(F.max("chunks").alias("chunks"))
    bounds = known.select("bucket", "grp", F.posexplode("gaps").alias("cell", "gap")).groupBy("bucket", "grp", "cell").agg(F.min("gap").alias("gap"))
    rows = rows.withColumn("bucket", bucket)
    cells = rows.groupBy("bucket", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
    # which cells serve which groups, with the rows' number at most: of bounded size, see above
    serves = bounds.join(cells, ["bucket", "cell"]).where("widest >= gap")
    sizes = serves.groupBy("grp").agg(F.sum("n").alias("n")).join(chunks, "grp")
    sizes = sizes.select("grp", "chunks", F.ceil(F.col("n") / per_share).cast("int").alias("shares"))
    serves = materialize(serves.select("bucket", "cell", "grp", "gap").join(sizes, "grp"), "serves")
    sent = rows.join(F.broadcast(serves), ["bucket", "cell"]).where("angle >= gap")
    sent = sent.withColumn("share", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.col("shares")).cast("int"))
    sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("grp", "chunk", "share", "vec_id", "label", "vec")
    shares = F.broadcast(serves.select("grp", "shares").distinct())
    asked = known.join(shares, "grp").withColumn("chunk", F.pmod(F.xxhash64("a", F.lit(19)), F.col("chunks")).cast("int"))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("grp", "chunk", "share", "a", "vec_id", "label", "vec", "lo", "hi")
    keys = ["grp", "chunk", "share"]
    found = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_local(same, k), FOUND)
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def hard_negatives(
    embeddings: DataFrame, anchor: str = "vec_id % 50 = 0", label: str = "CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95, per_share: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` per cent of the positive's.
    """
    spark: SparkSession = embeddings.sparkSession
    named = embeddings.select("vec_id", F.expr(label).alias("label"), "embedding")
    rows, sphere = placed(named)
    anchors = rows.where(anchor).select("vec_id", "label", "vec").distinct()
    anchors = materialize(anchors.withColumn("a", F.monotonically_increasing_id()), "asking")
    everything = {"lo": F.array(F.lit(LEAST).cast("long")), "hi": F.array(F.lit(MOST).cast("long"))}
    if not len(sphere.ids):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    good = materialize(window_join(anchors.withColumns(everything), rows, sphere, True, positives, per_share), "positives")
    # of windows, which are whole numbers: from ceil(low * s / 100) to floor(high * s / 100); empty below 0
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("vec_id").alias("id"), F.col("score").alias("s"))))
    pairs = good.where("score >= 0").groupBy("a").agg(order.alias("p"))
    # whole hundreds and what is left apart, so that products stay in 64 bits
    share = lambda s, per, to_whole: F.call_function("div", s, F.lit(100)) * per + to_whole((s % 100) * per / 100).cast("long")
    lo, hi = F.transform("p", lambda x: share(x["s"], low, F.ceil)), F.transform("p", lambda x: share(x["s"], high, F.floor))
    asking = materialize(anchors.join(pairs, "a").withColumns({"lo": lo, "hi": hi}), "windows")
    bad = window_join(asking, rows, sphere, False, negatives, per_share)
    told = asking.select("a", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("w", "p"))
    rank = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id"))
    bad = bad.withColumn("rank", rank).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return bad.join(told, ["a", "w"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.s").alias("positive_score"), "negative_score"
    )

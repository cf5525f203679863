"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A text's paragraphs are its lines, and longer lines are cut at words whose hash
ends in three zero bits, so that an edit changes only the paragraphs around it.
Each paragraph's digest (64 bits, of its words and of how often it has come
before in the text) enters three cells of a sketch: a cell holds a count, the
exclusive or of its digests, and that of their check hashes. Subtracting two
sketches cancels the paragraphs they share; peeling cells of one digest recovers those that
differ. Where peeling gets stuck, both texts get sketches four times larger and it
starts anew.

The fingerprint is the sketch of ``CELLS`` cells with the number of paragraphs, of which each
hash uses a third (30 of 32); its checks are short. It tells texts apart and peels for a few differences; likeness
is computed from fresh sketches, whose checks are whole and whose cells grow until peeling ends.
Likeness is shared paragraphs over all paragraphs of either text; two texts
without words are alike (1), and a text without words is unlike all others (0).

Defined cases: null texts are empty; equal texts have equal fingerprints; rows
with equal doc_id follow each other in order of a hash of their texts; null doc_ids come first; an
empty table gives no rows; a single row is its own next; further columns are ignored.

The next document by doc_id: quantiles of doc_id cut the rows into ranges, and
within a range, sorted, the next row streams by. The first row of each range is
sent to the range before it as well, so the texts are shuffled once (compressed
in their tasks) and no range waits for another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WordHashes, mix64, small_batches

CELLS = 32
HASHES = 3
PER_BATCH = 256
#: Fixed odd numbers that set the hashes apart.
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct digests of the text's paragraphs."""
    lines = [w for line in text.encode().split(b"\n") if (w := line.split())]
    if not lines:
        return np.empty(0, np.uint64)
    words = [w for line in lines for w in line]
    h = hashes.of(words)
    first = np.zeros(len(h), bool)
    first[np.cumsum([0, *map(len, lines[:-1])])] = True
    first[1:] |= (h[:-1] & np.uint64(7)) == 0
    begin = np.flatnonzero(first)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(h)))).astype(np.uint64)
    digest = np.sort(mix64(np.add.reduceat(mix64(h + place * _STEP), begin)))
    # the second of equal paragraphs is a digest of its own, and so on
    new = np.ones(len(digest), bool)
    new[1:] = digest[1:] != digest[:-1]
    if new.all():
        return digest
    at = np.flatnonzero(new)
    nth = np.arange(len(digest)) - np.repeat(at, np.diff(np.append(at, len(digest))))
    return np.sort(np.where(nth > 0, mix64(digest + nth.astype(np.uint64) * _STEP), digest))


def _sketches(digests: np.ndarray, owner: np.ndarray, owners: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checks of owners * cells cells; digest i enters three cells of owner[i]."""
    count = np.zeros(owners * cells, np.int64)
    key, check = np.zeros(owners * cells, np.uint64), np.zeros(owners * cells, np.uint64)
    _enter(count, key, check, digests, owner, np.ones(len(digests), np.int64), cells)
    return count, key, check


def _cells_of(digests: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """Three different cells: each hash has a third of them."""
    third = cells // HASHES
    return np.stack([owner * cells + k * third + (mix64(digests ^ _SEED[k]) % np.uint64(third)).astype(np.int64) for k in range(HASHES)])


def _enter(count, key, check, digests, owner, sign, cells) -> None:
    marks = mix64(digests * _CHECK + np.uint64(1))
    for at in _cells_of(digests, owner, cells):
        np.add.at(count, at, sign)
        np.bitwise_xor.at(key, at, digests)
        np.bitwise_xor.at(check, at, marks)


def _differences(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> np.ndarray:
    """(n, 2): digests of the left text only and of the right only, recovered from sketches, for all pairs at once."""
    out = np.zeros((len(pairs), 2), np.int64)
    todo = np.arange(len(pairs))
    while len(todo):
        left = np.concatenate([pairs[i][0] for i in todo])
        right = np.concatenate([pairs[i][1] for i in todo])
        of_left = np.repeat(np.arange(len(todo)), [len(pairs[i][0]) for i in todo])
        of_right = np.repeat(np.arange(len(todo)), [len(pairs[i][1]) for i in todo])
        count, key, check = _sketches(left, of_left, len(todo), cells)
        c2, k2, h2 = _sketches(right, of_right, len(todo), cells)
        count, key, check = count - c2, key ^ k2, check ^ h2
        found = np.zeros((len(todo), 2), np.int64)
        live = np.arange(len(count))
        while len(live):
            pure = live[(np.abs(count[live]) == 1) & (check[live] == mix64(key[live] * _CHECK + np.uint64(1)))]
            if not len(pure):
                break
            owner, digest, sign = pure // cells, key[pure], count[pure]
            # a digest may stand alone in several cells of its owner: it is taken out once
            _, once = np.unique(np.stack([owner.astype(np.uint64), digest]), axis=1, return_index=True)
            owner, digest, sign = owner[once], digest[once], sign[once]
            np.add.at(found, (owner, (sign < 0).astype(np.int64)), 1)
            _enter(count, key, check, digest, owner, -sign, cells)
            live = np.unique(_cells_of(digest, owner, cells))
        stuck = ((count != 0) | (key != 0)).reshape(len(todo), cells).any(axis=1)
        out[todo[~stuck]] = found[~stuck]
        todo, cells = todo[stuck], cells * 4
    return out


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Shared over all paragraphs of each pair, from what peeling recovers."""
    sizes = np.array([(len(a), len(b)) for a, b in pairs], np.int64).reshape(-1, 2)
    # a start near the difference that sizes alone allow spares rounds that must fail
    out = np.empty(len(pairs))
    wide = sizes.max(axis=1)
    for low, high, cells in ((0, 24, CELLS), (24, 96, 4 * CELLS), (96, 1 << 62, 16 * CELLS)):
        at = np.flatnonzero((wide >= low) & (wide < high))
        if len(at):
            gone = _differences([pairs[i] for i in at], cells)
            total = sizes[at].sum(axis=1)
            shared = (total - gone.sum(axis=1)) / 2
            union = total - shared
            out[at] = np.where(union > 0, shared / np.maximum(union, 1), 1.0)
    return out.tolist()


def encoded(digests: list[np.ndarray]) -> list[str]:
    """The fingerprint of each set: number of paragraphs, then each cell's count, digest and check, in base64."""
    owner = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    count, key, check = _sketches(np.concatenate(digests) if digests else np.empty(0, np.uint64), owner, len(digests), CELLS)
    cell = np.empty(len(count), [("n", "<i4"), ("key", "<u8"), ("check", "<u2")])
    cell["n"], cell["key"], cell["check"] = count, key, check >> np.uint64(48)
    body = cell.reshape(len(digests), CELLS)
    return [f"{len(d)}:{base64.b64encode(row.tobytes()).decode()}" for d, row in zip(digests, body, strict=True)]


def _rows(held: list[tuple[int, str, str]], hashes: WordHashes) -> pa.RecordBatch:
    """(doc_id, text, next text) -> the report's rows."""
    edited = []
    for _, text, after in held:
        n = len(text) // 4
        edited.append(text[: len(text) - n] + after[:n])
    known: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in known:
            known[text] = paragraphs(text, hashes)
        return known[text]

    own, new, nxt = ([of(t) for t in texts] for texts in ([h[1] for h in held], edited, [h[2] for h in held]))
    near = likeness([*zip(own, new, strict=True), *zip(own, nxt, strict=True)])
    marks = encoded([*own, *new])
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h[0] for h in held], pa.int64()), pa.array([len(h[1]) for h in held], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(marks[:n], pa.string()), pa.array(marks[n:], pa.string()),
            pa.array(near[:n], pa.float64()), pa.array(near[n:], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


PACKED = "range int, doc_id long, tie long, packed binary"


def _ranged(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) -> PACKED: range by the cuts (null in the first), text compressed, tie its hash."""
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            at = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at)
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            tie = np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64).view(np.int64)
            columns = [pa.array(at.astype(np.int32)), ids, pa.array(tie), pa.array([press.compress(d) for d in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "doc_id", "tie", "packed"])

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, doc_id, packed), sorted; the row after a range's last one has that range too, and is only read."""
    hashes, last, held, open_ = WordHashes(), None, [], zstandard.ZstdDecompressor()
    for batch in batches:
        for part, doc, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = open_.decompress(packed).decode()
            if last is not None and last[0] == part:
                held.append((last[1], last[2], text))
            last = (part, doc, text)
            if len(held) >= PER_BATCH:
                yield _rows(held, hashes)
                held = []
    if held:
        yield _rows(held, hashes)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of documents.

    The edited text is the text with its last quarter replaced by as much of the
    next document's beginning.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    cuts = np.unique(np.array(cuts, np.int64))

    packed = docs.mapInArrow(_ranged(cuts), PACKED)
    # ranges of ids alone, with the same cuts
    ids = docs.select("doc_id", F.lit(None).cast("string").alias("text")).mapInArrow(_ranged(cuts), PACKED).select("range", "doc_id")
    # the first id of each range, null before all: as many rows as ranges
    least = ids.groupBy("range").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("range").collect()
    if not least:
        return spark.createDataFrame([], OUT)
    firsts = [None if r["null"] else r["id"] for r in least]
    after = [(i + 1) % len(least) for i in range(len(least))]
    heads = spark.createDataFrame([(r["range"], firsts[j], least[j]["range"]) for r, j in zip(least, after, strict=True)], "before int, head long, own int")
    # of rows with the same first id, the range before gets the first one in order
    guards = docs.join(F.broadcast(heads.select("head")), docs["doc_id"].eqNullSafe(F.col("head"))).select("doc_id", "text").mapInArrow(_ranged(cuts), PACKED)
    guards = guards.join(F.broadcast(heads.select("before", "own")), F.col("range") == F.col("own"))
    guards = guards.groupBy("before").agg(F.min(F.struct("tie", "packed", "doc_id")).alias("d")).select(F.col("before").alias("range"), "d.doc_id", "d.tie", "d.packed")
    rows = packed.withColumn("guard", F.lit(0)).unionByName(guards.withColumn("guard", F.lit(1)))
    rows = rows.repartition("range").sortWithinPartitions("range", "guard", F.col("doc_id").asc_nulls_first(), "tie").select("range", "doc_id", "packed")
    return rows.mapInArrow(_in_order, OUT)

"""Near duplicates and fingerprints."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import xxhash

import tidewell.llm.near_dedup as nd
from tidewell.llm.fingerprint import fingerprints, likeness


def check(df, rows):
    got = {}
    for r in nd.near_duplicates(df).collect():
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
        if r.doc_id is not None:
            assert got.setdefault(r.doc_id, (r.n_shingles, r.component_id)) == (r.n_shingles, r.component_id)
    known = list({(d, t) for d, t in rows if d is not None})
    want = brute.components(known)
    assert got == {d: (len(brute.shingles(t)), want[d]) for d, t in known}
    return want


def test_equals_all_pairs(docs, rows):
    want = check(docs, [r[:2] for r in rows])
    assert sum(d != c for d, c in want.items()) >= 4
    assert nd.near_duplicates(docs).count() == len(rows)


def test_hot_mixed_group_is_split_without_losing_links(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(nd, "BLOCK", 16)
    want = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert 10 < sum(d != c for d, c in want.items()) < 260


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(5, 5)], "a long, b long")
    got = {r.node: r.comp for r in nd.connected_components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}


def test_keep_one(docs, rows):
    out = nd.keep_one(docs)
    want = brute.components([(d, t) for d, t, *_ in {r[:2] for r in rows if r[0] is not None}])
    assert out.columns == docs.columns
    full = Counter(map(tuple, docs.collect()))
    assert all(full[tuple(r)] for r in out.collect())  # whole rows, of whatever column names
    ids = sorted((r.doc_id for r in out.collect() if r.doc_id is not None))
    assert ids == sorted({d for d, c in want.items() if d == c})
    assert out.where("doc_id IS NULL").count() == 2


def test_rows_of_one_doc_id_are_judged_each(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    near = text(1).replace("w1x39", "other")
    rows = [(1, text(1)), (1, text(2)), (1, text(3)), (1, text(3)), (2, text(4)), (2, near), (3, text(2).upper()), (3, text(2)), (4, ""), (4, None), (None, text(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, text(1)), (1, text(2)), (1, text(3)), (2, text(4)), (4, ""), (4, None), (None, text(1))]
    assert Counter(map(tuple, nd.keep_one(df).collect())) == Counter(want)
    # in the report, a doc_id stands for all of its texts
    assert {(r.doc_id, r.component_id) for r in nd.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}


def test_min_max_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
    ratios = []
    for _ in range(20):
        x, y = (np.concatenate([common, rng.integers(0, 1 << 63, 75, dtype=np.uint64)]) for _ in range(2))
        ratios.append((nd.signature(x, nd._FINE_MULTIPLY, nd._FINE_ADD) == nd.signature(y, nd._FINE_MULTIPLY, nd._FINE_ADD)).mean())
    assert abs(np.mean(ratios) - 0.85) < 0.01


def test_fingerprints_equal_set_arithmetic(docs, rows):
    order = sorted((r[:2] for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh3_64_intdigest((r[1] or "").encode()) + 2**63) % 2**64))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]

        def like(a, b):
            a, b = Counter(brute.paragraphs(a)), Counter(brute.paragraphs(b))
            return round((a & b).total() / (a | b).total(), 9) if a or b else 1.0

        want.append((doc if doc is not None else -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, after)))
    out = fingerprints(docs).collect()
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out]
    assert sorted(got) == sorted(want)
    by_text = {}
    texts = {(r[0], len(r[1] or "")): r[1] or "" for r in rows}
    for r in out:
        assert by_text.setdefault(texts[r.doc_id, r.n_chars], r.fingerprint) == r.fingerprint


def test_peeling_retries_until_all_is_recovered():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (23, 3000))
    both = np.unique(np.concatenate([a, b]))
    assert likeness([(a, b), (a, both), (both, both), (a[:0], a[:0]), (a, a[:0])]) == [0.0, len(a) / len(both), 1.0, 1.0, 0.0]


def test_empty_tables(no_docs):
    assert nd.near_duplicates(no_docs).count() == 0 and nd.keep_one(no_docs).count() == 0 and fingerprints(no_docs).count() == 0


def test_keep_one_at_another_threshold(spark):
    rng, base = random.Random(11), [f"w{i}" for i in range(104)]  # 100 shingles

    def changed(n):
        words = list(base)
        for k in range(n):
            words[-1 - k] = f"x{rng.randrange(10**9)}"
        return " ".join(words)

    # n changed words at the end: 100 - n shingles of 100 + n remain
    rows = [(1, " ".join(base)), (2, changed(9)), (3, changed(12))]
    like = [len(a & b) / len(a | b) for a, b in ((brute.shingles(rows[0][1]), brute.shingles(t)) for _, t in rows[1:])]
    assert 0.80 <= like[0] < 0.85 and like[1] < 0.80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in nd.keep_one(df, 80).collect()} == {1, 3}
    assert {r.doc_id for r in nd.keep_one(df).collect()} == {1, 2, 3}


def test_bands_and_agreement_follow_the_threshold():
    assert (nd.bands_for(85), nd.agree_for(85)) == (nd.BANDS, nd.AGREE)
    assert 360 < nd.agree_for(80) < 370
    for percent in (80, 85, 90):  # the chance to share no band, or one
        n, p = nd.bands_for(percent), (percent / 100) ** nd.ROWS
        assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) < 1e-6

"""Hard negatives, collocations and URL filters, each held against a plain definition."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import collocations as col
from tidewell.llm import hard_negatives as hn
from tidewell.llm.url_filter import RULES, Trie, judge, permitted

SHAPE = "vec_id long, embedding array<float>, label int, a long, w int, score long, cell int, angle double, lo string, hi string, grp int, share int, n long"


def vectors(n, rng, clusters=0, width=6):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters or 1)]
    out = []
    for i in range(n):
        c = centres[rng.randrange(len(centres))] if clusters else [0.0] * width
        out.append((i, [float(np.float32(x + rng.gauss(0, 0.05 if clusters else 0.4))) for x in c], rng.randrange(10)))
    return out


def brute_negatives(rows, positives=5, negatives=3):
    known = set()
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in q) < 2**62:
            known.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    out = []
    for vec_id, label, q in (r for r in known if r[0] % 50 == 0):
        score = lambda r: sum(x * y for x, y in zip(q, r[2], strict=False))  # noqa: E731,B023
        same = sorted({(-score(r), r[0]) for r in known if r[1] == label and r[0] != vec_id})
        other = sorted({(-score(r), r[0]) for r in known if r[1] != label})
        for s, positive in same[:positives]:
            fit = [(-t, i) for t, i in other if 50 * -s <= 100 * -t <= 95 * -s]
            out += [(vec_id, positive, k + 1, i, -s, t) for k, (t, i) in enumerate(fit[:negatives])]
    return Counter(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, "l", "h", 6, 7, 8) for r in rows], SHAPE).repartition(3)
    return Counter(tuple(r) for r in hn.hard_negatives(df, **more).collect())


def test_negatives_equal_brute_force(spark):
    rng = random.Random(5)
    rows = vectors(700, rng) + vectors(300, random.Random(6), clusters=9)[150:]
    rows += [(1000, None, 1), (1001, [0.1] * 6, None), (1050, [0.1, None, 0.2], 1), (1100, [float("nan")] * 6, 2), (1150, [float("inf"), 0.0], 2), (None, [0.5] * 6, 3)]
    rows += [(2000, [1.5, 0.5], 4), (2050, [], 5), (2100, [0.0] * 6, 4), (2150, [3e38] * 6, 4), (2151, [1e7] * 6, 4), (2200, [1e6, -1e6, 3.0, 0.0, 0.0, 1.0], 4)]
    rows += [rows[50], rows[50], rows[3], (100, [0.3] * 6, 7)]  # repeats, and another vector under an anchor's number
    rows += [(3000 + i, [0.25] * 6, i % 3) for i in range(60)]  # ties
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_negatives_in_many_groups_and_shares(spark, monkeypatch):
    rows = vectors(1500, random.Random(8), clusters=25)
    want = brute_negatives(rows)
    for name, value in (("PIVOTS", 40), ("ANCHORS", 3), ("LABELS", 4)):
        monkeypatch.setattr(hn, name, value)
    assert mined(spark, rows, per_share=70) == want


def test_bounds_keep_rows_from_groups(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 4)
    unit = lambda v: [x / math.hypot(*v) for x in v]
    df = spark.createDataFrame([(i, unit(v), 1, 1, 2, 3, 4, 0.5, "l", "h", 6, 7, 8) for i, v, _ in vectors(3000, random.Random(9), clusters=30)], SHAPE)
    rows, sphere = hn.placed(df)
    anchors = rows.where("vec_id % 50 = 0").select("vec_id", "label", "vec").withColumn("a", F.col("vec_id"))
    anchors = anchors.withColumns({"lo": F.array(F.lit(hn.LEAST)), "hi": F.array(F.lit(hn.MOST))})
    seen = []
    bounded = hn.materialize
    monkeypatch.setattr(hn, "materialize", lambda frame, label: seen.append((label, out := bounded(frame, label))) or out)
    hn.window_join(anchors, rows, sphere, True, 5)
    serves = dict(seen)["serves"]
    per_bucket = rows.groupBy(F.pmod(F.xxhash64("label"), F.lit(hn.LABELS)).cast("int").alias("bucket"), "cell").agg(F.collect_list("angle").alias("angles"))
    sent = serves.join(per_bucket, ["bucket", "cell"]).select(F.sum(F.size(F.filter("angles", lambda x: x >= F.col("gap"))))).first()[0]
    everything = serves.select("bucket", "grp").distinct().join(rows.groupBy(F.pmod(F.xxhash64("label"), F.lit(hn.LABELS)).cast("int").alias("bucket")).count(), "bucket").select(F.sum("count")).first()[0]
    assert 0 < sent < 0.5 * everything


def test_negatives_of_nothing(spark):
    assert not mined(spark, []) and not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) and not mined(spark, [(50, [1.0], 1)])
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2)]) == {(50, 51, 1, 52, 65536, 58880): 1}


def brute_phrases(rows, least, longest=3, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, found in f.items():
        known = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in known.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(a, around[p[i : i + size]])
        rows = []
        for p, a in known.items():
            if 100 * around[p] >= covered * a and around[p]:
                continue
            score, _, l, r = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return Counter(out)


def speech():
    rng = random.Random(4)
    words = ["the", "Of", "new", "york", "é", "ÀB", "x\x01y", "a-b", "\U0001f600", "city"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(60):
        text = "".join(rng.choices(words, [30, 10, 6, 6, 3, 2, 2, 2, 1, 4] + [1] * 30)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(150))
        rows.append((text + " new york city the the the the of the", ["en", "de", None, "en"][i % 4]))
    return [*rows, (None, "en"), ("", None), (" \n.,", "xx"), rows[0], ("THE OF " * 9000, "en"), ("long. " + "q w e r t " * 3000, None)]


def counted(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, "s", 1, "p", 2, 3, 4) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a long, f string, k long, n long, size long")
    return Counter(tuple(r) for r in col.collocations(df.repartition(3), **more).collect())


def test_collocations_equal_brute_force(spark):
    rows = speech()
    assert len(want := brute_phrases(rows, 10)) > 60
    assert counted(spark, rows) == want
    assert counted(spark, rows, least=4, top=7) == brute_phrases(rows, 4, top=7)


def test_collocations_of_hot_words_and_small_blocks(spark, monkeypatch):
    rows = speech()
    monkeypatch.setattr(col, "SAMPLE", 1.0)
    hot, total = col.hot_slots(spark.createDataFrame([(lang or "und", t) for t, lang in rows], "lang string, text string"), 400)
    assert 3 < hot.sum() < 60 and total > 20_000
    df = spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string")
    for most in (20, 400, 3000):
        marks = np.random.default_rng(most).random(1 << 18) < min(1, 200 / most)
        monkeypatch.setattr(col, "hot_slots", lambda docs, n, marks=marks: (marks, 100_000))
        found = {(r.lang, r.phrase): r.f for r in col.phrase_counts(df.repartition(4), 10, flush=500).collect()}
        monkeypatch.setattr(col, "hot_slots", lambda docs, n: (np.zeros(1 << 18, bool), 0))
        assert found == {(r.lang, r.phrase): r.f for r in col.phrase_counts(df, 10).collect()}
        assert Counter(tuple(r) for r in col.collocations(df).collect()) == brute_phrases(rows, 10)


def test_longer_collocations(spark):
    rows = speech()
    df = spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string")
    got = Counter(tuple(r) for r in col.collocations(df, max_words=5).collect())
    assert got == brute_phrases(rows, 10, longest=5)


def test_text_in_parts():
    text = "Aa b. c d\te\nf " * 9
    assert [w for part in col.tokens(text, 7) for w in part] == [*next(iter(col.tokens(text)))] or len(list(col.tokens(text, 7))) > 1
    clean = lambda parts: [w for part in parts for w in part if w]
    assert clean(col.tokens(text, 7)) == clean(col.tokens(text))


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 10**14
    frame = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 7 * big), ("en", "a b", 2, big + 1), ("en", "", 0, 10 * big)], col.COUNTED)
    monkeypatch.setattr(col, "phrase_counts", lambda *a: frame)
    row = col.collocations(frame).first()
    assert row.score == 10**6 * (big + 1) ** 2 // (21 * big * big) and row.n == 10 * big


def test_collocations_of_nothing(spark):
    assert not counted(spark, []) and not counted(spark, [(None, None), ("a b c", "en")])


URLS = [
    None, "", "no address", "http://", "://org/x", "https://a.org", "https://a.org/", "https://org/x", "http://ORG/X", "http://xorg/a", "http://b.Example.ORG/es/1?q=/en/", "http://example.org/es",
    "http://example.org/en/1", "http://example.org/en/12/3", "http://example.org/en/2", "http://example.org//en/1", "http://u:p@a.com:80/fr/", "http://a.com:80/fr/", "http://a.com/fr/#x", "http://a.com/fr?/",
    "http://a.com/de/\nx", "http://com/de/", "x://y.com/fr/://z.org/", "http://a..org/", "http://.org/", "http://org./", "//a.org/", "http://a.com\n/fr/", "http://a.com?x=/fr/",
]


def brute_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count("."), len(p or ""), v == "block", h + (p or ""), v) for h, p, v in rules if h and ("." + host).endswith("." + h) and path.startswith(p or "")] if host else []
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "h", "p", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, rule string, verdict string")


def test_url_filter_equals_brute_force(spark):
    got = {r.page_id: tuple(r)[1:] for r in judge(pages_of(spark, URLS)).collect()}
    assert got == {i: brute_judge(u, RULES) for i, u in enumerate(URLS)}
    kept = permitted(pages_of(spark, URLS)).collect()
    assert [tuple(r) for r in kept] == [(i, u, "<p>", "h", "p", "r", "v") for i, u in enumerate(URLS) if got[i][3] == "allow"]


@pytest.mark.parametrize("seed", range(3))
def test_trie_and_join_agree(spark, seed):
    rng = random.Random(seed)
    labels, segments = ["a", "b", "org", "com", "", "é"], ["x", "xy", "en", "", "1", "xyz"]
    path = lambda: "".join("/" + rng.choice(segments) for _ in range(rng.randrange(4)))
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [(None, "/x", "block"), ("", "/", "block"), ("org", None, "block")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}" for _ in range(150)] + URLS
    trie = Trie(rules)
    want = {i: brute_judge(u, rules, "block") for i, u in enumerate(urls)}
    for url in urls:
        h, p, rule, verdict = brute_judge(url, rules, None)
        assert (trie.find(h, p) or (None, None)) == (rule, verdict)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (1000, 5):  # by trie, and by join
        assert {r.page_id: tuple(r)[1:] for r in judge(pages_of(spark, urls), table, "block", most=most).collect()} == want
    with pytest.raises(ValueError):
        judge(pages_of(spark, urls), rules, most=5)


def test_url_filter_of_nothing(spark):
    assert judge(pages_of(spark, [])).count() == 0
    assert {r.verdict for r in judge(pages_of(spark, URLS), [], "block").collect()} == {"block"}

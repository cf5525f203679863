"""Archive, packing, mixing, classifier, language identification and the pipeline."""

import base64
import hashlib
import html as html_lib
import json
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import tidewell.llm.language_id as li
import tidewell.llm.packing as pk
import tidewell.llm.quality_model as qm
import tidewell.llm.web_archive as wa
from tidewell.llm.language_id import identify
from tidewell.llm.mixing import WEIGHTS, mix, mixed_documents, sainte_lague
from tidewell.llm.quality_model import cutoff, resample, top_k_threshold
from tidewell.llm.web_archive import archive_report, parse_warc, read_archive, to_warc, write_archive

DATA = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, digest string, payload string, n long"


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 9, "x\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "y" * 100_000]
    rows = [(i, None if i == 4 else f"http://h/{i}", h, "d", "p", 1) for i, h in enumerate(html)] + [(5, "http://h/5", html[5], "d", "p", 1)]
    return spark.createDataFrame(rows, PAGES)


def test_archive_round_trip(spark, pages, tmp_path):
    rows = pages.collect()
    first, want = {}, Counter()
    for r in sorted(rows, key=lambda r: r.page_id):
        data = (r.html or "").encode()
        kind = "revisit" if data in first else "response"
        first.setdefault(data, r.page_id)
        want[r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first[data] if kind == "revisit" else None] += 1
    got = Counter(tuple(r) for r in archive_report(pages).collect())
    assert got == want
    folder = f"file://{tmp_path}/archive"
    write_archive(pages, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len(first)
    html = {r.page_id: (r.html or "").encode() for r in rows}
    for r in to_warc(read_archive(spark, folder)).collect():
        ((fields, block),) = parse_warc(bytes(r.record))
        assert block == (b"" if fields["WARC-Type"] == "revisit" else html[r.page_id])
    assert archive_report(pages.limit(0)).count() == 0


def test_hot_payloads_are_read_in_parts(spark, tmp_path, monkeypatch):
    """One body on half of the pages: no part of its records is much larger than asked, and every record comes back."""
    rows = [(None if i < 5 else i // 2, f"http://h/{i}", "page was not found" if i % 2 else f"<p>{i}</p>") for i in range(2_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    write = wa.write_archive
    monkeypatch.setattr(wa, "write_archive", lambda pages, folder: write(pages, folder, spread=50))
    before = {t.name for t in spark.catalog.listTables()}
    folder = f"file://{tmp_path}/archive"
    out = archive_report(pages, folder).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    headers = spark.read.parquet(f"{folder}/headers")
    sizes = [r["count"] for r in headers.where("part IS NOT NULL").groupBy("digest", "part").count().collect()]
    assert sum(sizes) == 1_000 and len(sizes) == 20 and max(sizes) <= 3 * 50
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(html, page)
    want = Counter()
    for page, _, html in rows:
        want[page, len(html)] += 1
    assert Counter((r.page_id, r.payload_bytes) for r in out) == want
    hot = [r for r in out if r.payload_bytes == len("page was not found")]
    assert sum(r.record_type == "response" for r in hot) == 1
    assert {r.refers_to for r in hot if r.record_type == "revisit"} == {first["page was not found"]}
    ids = [parse_warc(bytes(r.record)).__next__()[0]["WARC-Record-ID"] for r in to_warc(read_archive(spark, folder)).collect()]
    assert len(set(ids)) == len(rows)


def test_pieces_are_the_tokenizers(docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = ["hello <|endoftext|> world <|startoftext|>", "<|endoftext|>", "x<|ENDOFTEXT|>y <|endoftext|", "a<|endoftext|>b " * 3000]
    rows = [*rows, *[(900 + i, t, *rows[0][2:]) for i, t in enumerate(more)]]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(rows[-len(more) :], docs.schema))
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[doc, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    out = pk.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_packing(out)
    with_ids = pk.pack_documents(docs, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in with_ids) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids)


def test_bulk_merges_are_the_vocabularys():
    """Each token, built from its bytes by lower-ranked tokens alone, ends in the pair that the vocabulary merges: so both merge alike."""
    path = public_tokenizers.path("word_bpe_49k.json")
    model = json.loads(Path(path).read_text())["model"]
    rank = {}
    for i, (a, b) in enumerate(model["merges"]):
        assert rank.setdefault(a + b, i) == i and rank.get(a, -1) < i and rank.get(b, -1) < i
        assert i == 0 or model["vocab"][a + b] > model["vocab"]["".join(model["merges"][i - 1])]
        token, end = (a + b).removesuffix("</w>"), (a + b).endswith("</w>")
        parts = [*token[:-1], token[-1] + "</w>"] if end else [*token]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda k: (rank.get(parts[k] + parts[k + 1], i), k))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [a, b]


def test_words_of_many_kinds():
    path = public_tokenizers.path("word_bpe_49k.json")
    known = pk.WordIds(path)
    for text in (
        "don't it's I'LL 'S x's", "naïve CAFÉ é ÅÅ ǅ ﬁ ß İx Σς ΑΣ", "a\x1cd\x85e \x01 a\x01 é x", "你好，世界 123 1.2.3 a1b2", "**bold**\t<|endoftext|> x<|endoftext|>y",
        "'s' -- !!! ᄀ ᄀ각", "\U0001f600x ‍z ªº ʰ x_y a-b (a) [b]. µ", "k" * 500,
    ):
        words = text.encode().split()
        known.learn(set(words))
        whole = known.whole(text)
        assert (whole if known.special.search(text) else known.of(words)) == whole
    assert known.merger
    rng = np.random.default_rng(1)
    letters = np.array([*"etaoinshrdlucmfwypvbgkjqxz", *"éäßÉÄÑñ"])
    plain = ["".join(rng.choice(letters, rng.integers(1, 14))) + rng.choice(["", ".", ",", "):", "?!"]) for _ in range(20_000)]
    known.learn({w.encode() for w in plain})
    assert known.of([w.encode() for w in plain]) == known.whole(" ".join(plain))


@pytest.mark.parametrize("low, high", [(400, 900), (300, 700)])
def test_pools_stay_bounded(spark, monkeypatch, low, high):
    """Lengths whose bound no packing reaches: every partition stays open, and no group of any round is much larger than asked."""
    seen, plain = [], pk.materialize

    def watched(df, label):
        out = plain(df, label)
        if label.startswith("packed"):
            seen.append(out.groupBy("grp").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(pk, "materialize", watched)
    sizes = np.random.default_rng(8).integers(low, high, 20_000).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, 1, i) for i, n in enumerate(sizes)], pk.PIECE)
    out = pk.pack_pieces(cut, group=200).collect()
    assert len(out) == len(sizes) and len(seen) >= 3 and max(seen) <= 200 + pk.FAN_IN * (2048 // low)
    check_packing(out)


def check_packing(out):
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_exchange_reaches_the_bound(spark):
    rng = np.random.default_rng(4)
    sizes = [*rng.integers(100, 900, 900).tolist(), *[1100] * 300, 2048, 2048]
    rows = [(i, 0, 0, int(n), 1, i) for i, n in enumerate(sizes)]
    cut = spark.createDataFrame(rows, pk.PIECE)
    bins = check_packing(pk.pack_pieces(cut, group=100).collect())
    alone = sum(pk.best_fit_decreasing(np.array(sorted(sizes[i::12], reverse=True)), 2048)[0].max() + 1 for i in range(12))
    whole = pk.best_fit_decreasing(np.array(sorted(sizes, reverse=True)), 2048)[0].max() + 1
    assert pk.lower_bound(np.array(sizes), 2048) <= whole <= bins <= min(whole + 4, alone)


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = np.sort(rng.integers(1, 101, rng.integers(1, 40)))[::-1]
        where, _ = pk.best_fit_decreasing(sizes, 100)
        assert pk.lower_bound(sizes, 100) <= where.max() + 1
    assert pk.lower_bound(np.array([60] * 10), 100) == 10
    assert pk.lower_bound(np.array([34] * 9), 100) == 5


def test_mix_meets_its_targets(docs, rows):
    size, total = Counter(), 0
    for _, text, _, source, *_ in rows:
        size[source] += len(brute.words(text))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s, w in weight.items() if s not in full and 2 * size[s] < level * w}
        if not more:
            break
        full |= more
    target = {s: 2 * size[s] if s in full else level * w for s, w in weight.items()}
    out = mix(docs).collect()
    again = mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    taken, by_size = Counter(), {n: s for s, n in size.items()}
    assert len(by_size) == len(size)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"] and abs(r.target - target[by_size[r.source_size]]) < 1e-6
        taken[by_size[r.source_size]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 128 for s in target)
    texts = Counter()
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    further = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert {tuple(r) for r in mixed.select(further).collect()} <= {tuple(r) for r in docs.select(further).collect()}
    for r in mixed.collect():
        texts[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in out:
        want[r.doc_id] += r.taken
    assert +want == texts


def test_sainte_lague_is_highest_quotients(spark):
    rng = np.random.default_rng(6)
    for seats in (0, 1, 7, 50):
        votes = [int(v) for v in rng.integers(0, 1000, 12)] + [5000, 0]
        want = Counter()
        for _ in range(seats):
            want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "id long, votes long, seats long")
        got = {r.id: r.quota for r in sainte_lague(df, "id", [], "votes", "seats").collect()}
        assert got == {i: want[i] for i in range(len(votes))}


def test_classifier_parts_labelled_kinds(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = resample(docs, labels)
    assert out.count() == docs.count()
    counts = Counter((r.quality, r.kept) for r in out.join(labels.where("toxic = 0"), "doc_id").collect())
    assert counts[1, True] >= 0.95 * (counts[1, True] + counts[1, False]) and counts[0, False] >= 0.8 * (counts[0, True] + counts[0, False])
    assert resample(docs, labels, k=17).where("kept").count() == 17


def test_classifier_equals_plain_python(spark, docs, rows):
    once = {d: t for d, t, *_ in rows if d is not None}
    good, bad = set(range(0, 30)), {*range(43, 58)}
    labels = spark.createDataFrame([*((d, 1, 0) for d in good), *((d, 0, 0) for d in bad), (40, 1, 1)], "doc_id long, quality int, toxic int")
    scored, cut = qm.score_documents(docs, labels)
    folds = {r[0]: r[1] for r in spark.range(60).select("id", F.pmod(F.xxhash64("id", F.lit(qm.SEED + 1)), F.lit(qm.FOLDS))).collect()}
    texts = [r[:2] for r in rows]
    assert len(once) == len({r[:2] for r in texts if r[0] is not None})
    # a repeated doc_id fits the models once, but counts in the raw model as often as it stands
    again = [i for i, r in enumerate(texts) if r in texts[:i] and r[0] in good]
    weights, share, best = brute.importance(texts, good, bad, folds, qm.BUCKETS, qm.PRIOR) if not again else (None,) * 3
    if again:  # leave the repeats' own target counts out
        marked = [(d if i not in again else -1 - i, t) for i, (d, t) in enumerate(texts)]
        weights, share, best = brute.importance(marked, good, bad, folds, qm.BUCKETS, qm.PRIOR)
    got = {(r.doc_id, round(r.log_weight, 6)) for r in scored.collect()}
    assert got == {(d, round(w, 6)) for (d, _), w in zip(texts, weights, strict=True)}
    assert abs(share(cut) - best) < 1e-9
    k = sum(w >= cut for w in weights)
    keys = [w + brute.gumbel(d, t, qm.SEED) for (d, t), w in zip(texts, weights, strict=True)]
    least = sorted(keys, reverse=True)[k - 1]
    out = resample(docs, labels).collect()
    want = Counter((d, round(key, 6), key >= least - 1e-9) for (d, _), key in zip(texts, keys, strict=True))
    assert Counter((r.doc_id, round(r.key, 6), r.kept) for r in out) == want and 0 < k < len(rows)
    # the noise decides: some documents below the cutoff are drawn, or some above it aren't, for one of these seeds
    assert any({(r.kept, r.log_weight >= cut) for r in resample(docs, labels, seed=s).collect()} - {(True, True), (False, False)} for s in range(20, 26))
    left = qm.keep_good(docs, labels)
    assert left.columns == docs.columns
    kept = Counter((d, t) for (d, t), key in zip(texts, keys, strict=True) if key >= least - 1e-9)
    full = {(r.doc_id, r.text): r for r in docs.collect()}
    assert Counter((r.doc_id, r.text) for r in left.collect()) == kept
    assert all(tuple(r)[5:18] == tuple(full[r.doc_id, r.text])[5:18] for r in left.collect())


def test_rows_of_one_doc_id_are_judged_each(spark):
    rng = np.random.default_rng(3)
    prose = lambda: " ".join(rng.choice(["river", "stone", "garden", "letter", "window"], 60))
    junk = lambda: " ".join(rng.choice(["@@@", "click", "$$$", "buy", "!!!"], 60))
    rows = [(i, prose() if i % 2 else junk()) for i in range(60)] + [(7, junk()), (None, prose()), (None, junk())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = Counter(map(tuple, qm.keep_good(df, labels).collect()))
    assert out == Counter(r for r in rows if "river" in r[1])


def test_labelled_rows_are_bounded(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    seen, plain = {}, qm.materialize

    def watched(df, label):
        out = plain(df, label)
        seen[label] = out.count()
        return out

    qm.materialize = watched
    try:
        many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
        qm.score_documents(many, labels, labelled=10)
    finally:
        qm.materialize = plain
    assert seen["marks"] == seen["known"] == 10


def test_classifier_edges(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resample(docs, none).where("kept").count() == len(rows)
    one = spark.createDataFrame([(0, 1, None), (1, 0, 0), (None, 1, 1), (2, None, 0), (0, 1, 0)], none.schema)
    assert resample(docs, one).count() == len(rows)
    assert resample(no_docs, one).count() == 0
    assert cutoff(np.array([1.0, 2.0, 3.0]), np.array([False, True, True])) == 1.5


def test_top_k_is_exact(spark):
    values = [float(x) for x in np.random.default_rng(7).normal(size=500)] + [0.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 10, 200, 520):
        assert top_k_threshold(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_language_of_pages(spark):
    docs, pages = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "pages"))
    # a document's own text as a page without markup: held-out rows, known language
    held = docs.where("doc_id % 3 = 0 AND length(text) > 60")
    rows = held.selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE concat('http://www.h', doc_id % 3, '.example.org/x') END AS url", "text AS html", "lang AS truth")
    out = identify(rows.select("page_id", "url", "html"), docs.where("doc_id % 3 <> 0")).join(rows.select("page_id", "truth"), "page_id").collect()
    assert sum(r.lang == r.truth for r in out) >= 0.97 * len(out) and len(out) > 20
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "not an address", "", "x"), (3, "http://a.de/", '<html lang="de">', "x"), (3, "http://a.de/", '<html lang="de">', "x"), (None, "http://a.de", "<p>" + "x" * 50_000, "x")], "page_id long, url string, html string, lang string")
    got = identify(odd.union(pages.selectExpr("page_id + 10", "url", "html", "'x'")), docs).where("page_id IS NULL OR page_id <= 3").collect()
    assert len(got) == 5 and all(r.lang is not None and 0 < r.confidence <= 1 for r in got)
    assert {r.lang for r in got if r.page_id == 3} == {"de"}
    assert identify(odd.limit(0), docs).count() == 0 and identify(odd, docs.limit(0)).where("lang IS NULL").count() == 5


LANGUAGE_WORDS = {
    "de": "der die und nicht haus strasse gestern wieder", "en": "the and not house street yesterday again over",
    "fr": "le la et pas maison hier encore toujours",
}


def test_language_equals_plain_python(spark):
    """Text, declared language, suffix, domain and host evidence, with ties, repeats and clashing names, against plain Python."""
    rng = np.random.default_rng(9)
    say = lambda lang, n: " ".join(rng.choice(LANGUAGE_WORDS[lang].split(), n))
    docs = [(i, lang, say(lang, 30)) for i, lang in enumerate(["de", "en", "fr"] * 5)]
    pages = []
    for i in range(60):
        lang = ["de", "en", "fr"][i % 3]
        tag = f'<html lang="{["de", "en", "xx"][i % 3]}-x">' if i % 4 else "<html>"
        host = ["www.a.de", "b.example.com", "c.example.com", "", "d.org"][i % 5]
        pages.append((i, f"http://{host}/x" if host else None, f"{tag}<head>{say('en', 9)}</head><p>{say(lang, int(rng.integers(0, 12)))}</p>"))
    pages += [(100, "http://www.a.de/y", "<p></p>"), (100, "http://www.a.de/y", "<p></p>"), (101, None, None), (102, "http://x@d.org:80/", '<html lang="de">' + say("fr", 3))]
    df = spark.createDataFrame([(*p, "z", 1.0, [1.0], "h") for p in pages], "page_id long, url string, html string, lang string, p double, text_ll array<double>, host string")
    known = spark.createDataFrame([(*d, "h", 1.0) for d in docs], "doc_id long, lang string, text string, _h string, n double")
    want = Counter(brute.languages(pages, [d[1:] for d in docs], li.BUCKETS, li.EVIDENCE, li.STRENGTH))
    out = identify(df.repartition(5), known)
    assert Counter((r.page_id, r.lang, round(r.confidence, 6)) for r in out.collect()) == want
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, identify(df.repartition(2), known).collect()))


def test_visible_text_is_linear_and_equals_the_pattern():
    odd = ["a<b>c</b>", "<script>x</script >y", "<script>never", "<nav><nav>x</nav>y</nav>", "<!-- a --> b <!-- c", "x < y", "<header>h</header>", "<<<a>>", "a<style>b</STYLE>&amp;c", "<head", "p<br", "<!--><p>q"]
    for page in odd:
        assert li.visible_text(page) == html_lib.unescape(brute.HIDDEN.sub(" ", page)), page
    begin = time.perf_counter()
    for part in ("<script>", "<!--", "<nav", "<"):
        li.visible_text(part * 200_000)
    assert time.perf_counter() - begin < 10


def test_many_languages(spark):
    docs = spark.createDataFrame([(i, f"l{i:03}", f"word{chr(97 + i % 26)} {chr(97 + i // 26)}other") for i in range(210)], "doc_id long, lang string, text string")
    pages = spark.createDataFrame([(i, "http://a.b/", f"word{chr(97 + i % 26)} {chr(97 + i // 26)}other") for i in (3, 205)], "page_id long, url string, html string")
    assert {(r.page_id, r.text_lang) for r in identify(pages, docs).collect()} == {(3, "l003"), (205, "l205")}


@pytest.mark.parametrize("repeated", [7, None])
def test_training_set_of_repeated_and_null_ids(spark, repeated):
    """Rows that share an id, or have none, neither crowd out the others nor pass the bound."""
    english = [(i, f"the weather of the north {i} and what they thought of it", "en") for i in range(60)]
    german = [(i + 60, f"das wetter im norden {i} und was sie davon hielten", "de") for i in range(60)]
    many = [(repeated, f"immer wieder derselbe satz {i % 50}", "de") for i in range(6000)]
    df = spark.createDataFrame(english + german + many, "doc_id long, text string, lang string")
    for bound in (100, 5000):
        langs, model = li.fit_text_model(df, bound)
        assert langs == ["de", "en"]
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>what they thought of the weather</p>"), (2, None, "<p>was sie davon hielten</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text_lang for r in identify(pages, df).collect()} == {1: "en", 2: "de"}


def test_packing_is_nearly_that_of_one_partition(spark):
    for low, high, seed in ((1, 2048, 1), (300, 1500, 2)):
        sizes = np.random.default_rng(seed).integers(low, high, 40_000)
        cut = spark.createDataFrame([(i, 0, 0, n, 1, i) for i, n in enumerate(sizes.tolist())], pk.PIECE)
        one = int(pk.best_fit_decreasing(np.sort(sizes)[::-1], 2048)[0].max()) + 1
        assert pk.pack_pieces(cut).select("sequence_id").distinct().count() == one
        assert pk.pack_pieces(cut, group=10_000).select("sequence_id").distinct().count() <= 1.0025 * one


def test_other_vocabularies_are_not_merged_in_bulk():
    spec = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    assert pk._merges_alike(spec)
    assert not pk._merges_alike(spec | {"pre_tokenizer": None}) and not pk._merges_alike(spec | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}})
    merges = spec["model"]["merges"]
    assert not pk._merges_alike(spec | {"model": spec["model"] | {"merges": [*merges[500:], *merges[:500]]}})


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    frames = [docs]
    for name, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], DATA).cache())
        if name != "packing":
            assert frames[-1].columns == docs.columns
    first, kept, unique, masked, mixed, packed = ({r.doc_id: r for r in f.collect()} for f in frames)
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and set(kept) < set(first)
    want = brute.components([(d, r.text) for d, r in kept.items()], 80)
    assert set(unique) == {d for d, c in want.items() if d == c}
    assert set(masked) == set(unique)
    for d, r in masked.items():
        clean = brute.secrets(unique[d].text)[:3] == (0, 0, 0)
        assert not clean or r.text == unique[d].text or "[REDACTED]" in r.text
        assert clean or "[REDACTED]" in r.text
    assert set(mixed) <= set(masked) and frames[4].count() > len(mixed) / 2
    rows = frames[5].collect()
    check_packing(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in frames[4].collect())


def test_pipeline_survives_nulls(spark, docs, no_docs, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("a", docs), ("b", no_docs)):
        df = rows.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in cp.STAGES:
            df = stage(spark, df, str(tmp_path)).cache()
        assert (df.count() > 10) == (name == "a")

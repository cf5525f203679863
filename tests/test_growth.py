"""Queries over tables that are small files of many rows, and steps whose work must grow no faster than their input."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.catalog import ORACLE_SQL, QUERIES, apps
from tidewell.functions import text, values
from tidewell.operators import aliases
from tidewell.sources.shared import dealt

DATA = "/root/testdata/sf0.001"


def test_front_matter_of_many_keys(spark):
    """What a line's key and value take is computed once a line, not again for each other line."""
    lines = "\n".join(f'k{i}: "v{i}"' for i in range(600)) + "\nk0: last"
    df = spark.createDataFrame([(f"---\n{lines}\n---\nbody",)], "d string")
    began = time.monotonic()
    loose, first = df.select(text.decoded_front_matter(F.col("d")), text.front_matter(F.col("d"))).first()
    assert len(loose) == len(first) == 600 and loose["k0"] == "last" and first["k0"] == "v0" and loose["k599"] == "v599"
    assert time.monotonic() - began < 10


@pytest.mark.parametrize("name", ["front_matters", "note_evidence", "search_rounds"])
def test_rows_of_a_small_file_go_to_all_cores(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_rows_of_releases_go_to_all_cores(spark):
    assert apps.release_rows(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_tasks_keep_their_size(spark):
    assert dealt(spark.range(1000), "id", rows=50).rdd.getNumPartitions() == 20


def test_cut_character_references(spark, tmp_path):
    """A page cut inside a character reference gives what the SQL gives; the function by itself decodes what browsers do."""
    pages = ["<p>a&amp", "<title>x&&&amp</title><p>b&amp;c &copy &copy; &quot</p>", "&", "&;&amp;amp;&#65;", "<a href='?a=1&b=2'>t</a> q&nosuch; r&", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n_chars, r.digest) for r in QUERIES["html_text"](spark, f"file://{tmp_path}").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {k: (n, d) for k, n, d in con.sql("SELECT page_id, n_chars, digest FROM (" + ORACLE_SQL["html_text"] + ")").fetchall()}
    del got[3], want[3]  # the SQL knows no numbers
    assert got == want and len(got) == 5
    assert [values.html_to_text(x) for x in ("a&amp", "a&amp;")] == ["a&", "a&"] and values.html_to_text("&;&amp;amp;&#65;", closed=True) == "&;&amp;A"


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_few_pieces_are_looked_up(spark, monkeypatch, bits):
    """Aliases that begin alike, in texts that hold hundreds of them: a few pieces a text are looked up, and with a filter that is full the result is the same."""
    monkeypatch.setattr(aliases, "BITS", bits)
    rng, seen, passing = random.Random(3), [], aliases._passing
    monkeypatch.setattr(aliases, "_passing", lambda *a: seen.append(passing(*a)) or seen[-1])
    word = lambda n: "same" + "".join(rng.choice("abc甲") for _ in range(n))
    known = [(f"n{rng.randrange(9)}", word(rng.randrange(6))) for _ in range(2000)] + [(f"m{i}", f"{i}") for i in range(3000, 9000)]
    texts = [(i, " ".join(word(rng.randrange(6)) for _ in range(200))) for i in range(60)] + [(900 + i, "x" * 300 + "3" * i) for i in range(6)]
    got = {r.key: (r.name, r.alias) for r in aliases.longest_alias(spark.createDataFrame(texts, "key long, t string"), spark.createDataFrame(known, "name string, alias string"), "key", "t").collect()}
    want = {key: max((len(a), n, a) for n, a in known if a in text)[1:] for key, text in texts if any(a in text for _, a in known)}
    assert got == want and len(want) == 62
    if bits == 1 << 27:
        assert seen[0].count() < 200 * len(texts) and seen[1].count() == 0

"""Aliases against all pairs, the log of events over restarts, the funnel against plain Python."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewell.operators import aliases
from tidewell.plans import research
from tidewell.streaming import events


def test_longest_alias_among_ten_thousand(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("甲乙丙丁戊己庚辛壬癸ab") for _ in range(n))
    known = sorted({(f"n{rng.randrange(3000)}", word(rng.randrange(1, 12))) for _ in range(10_000)} | {("z", ""), ("y", "  ")})
    texts = [(i, word(rng.randrange(60))) for i in range(150)] + [(900, None), (901, ""), (902, "\U0001f600")]
    got = {r.key: (r.name, r.alias) for r in aliases.longest_alias(spark.createDataFrame(texts, "key long, t string"), spark.createDataFrame(known, "name string, alias string"), "key", "t").collect()}
    want = {}
    for key, text in texts:
        hits = [(len(a), n, a) for n, a in known if a and text and a in text]
        if hits:
            want[key] = max(hits)[1:]
    assert got == want and len(want) > 100


def test_identified_in_order_of_evidence(spark):
    known = spark.createDataFrame([("k1", "国泰"), ("k2", "国泰君安"), ("k3", "某某 证券")], "name string, alias string")
    rows = [
        (1, "k1", "国泰君安", "", "", ""), (2, "nobody", "", "国泰君安证券", "", "国泰"), (3, None, None, None, "某某\n 证券", None), (4, "", "丁证券有限公司", "x", "", ""), (5, "", "", "丁证券", "", ""),
        (6, "", "", "银行", "", ""), (7, None, None, None, None, "x" * 3998 + "国泰君安"),
    ]
    df = spark.createDataFrame(rows, "id long, configured string, owner string, purchaser string, title string, body string")
    got = {r.id: r.name for r in aliases.identified(df, known, "id").collect()}
    assert got[1] == "k1" and got[2] == "k2" and got[3] == "k3" and got[4] == got[5] and got[4].startswith("broker_") and len(got[4]) == 19
    assert got[6] == "" and got[7] == "k1"  # what lies beyond the beginning doesn't count


def test_event_numbers_go_on_after_a_restart(spark, tmp_path):
    source, root, mark = f"file://{tmp_path}/in", f"file://{tmp_path}/log", f"file://{tmp_path}/mark"
    (tmp_path / "in").mkdir()
    put = lambda *rows: spark.createDataFrame(rows, "job string, e long, note string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: events.append_events(spark.readStream.schema("job string, e long, note string").parquet(source), root, mark, "job", ["e"])
    assert run().count() == 0
    put(("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"))
    assert {(r.job, r.e, r.sequence) for r in run().collect()} == {("a", 1, 1), ("a", 2, 2), ("b", 5, 1)}
    put(("a", 0, "late"), ("c", 9, None))
    put(*[("a", 10 + i, "m") for i in range(600)])
    log = run()
    got = defaultdict(list)
    for r in log.orderBy("sequence").collect():
        got[r.job].append(r.sequence)
    assert got == {"a": list(range(1, 604)), "b": [1], "c": [1]}
    last = events.replayed(log, "job")
    assert last.count() == 502 and last.where("job = 'a'").agg(F.min("sequence")).first()[0] == 104
    assert {(r.job, r.sequence) for r in events.replayed(log, "job", spark.createDataFrame([("a", 601), ("b", 1)], "job string, sequence long")).collect()} == {("a", 602), ("a", 603)}


def test_funnel_equals_plain_python(spark, tmp_path):
    rng = random.Random(9)
    hosts, titles = [f"h{i}.com" for i in range(6)], ["One", "one!", "Two", "", "Three x"]
    rows = []
    for execution in ("e1", "e2", "e3"):
        for rank in range(1, 41):
            day = None if rng.random() < 0.2 else dt.date(2024, 1, 1) - dt.timedelta(days=rng.randrange(700))
            rows.append((execution, rank, rng.choice(["", "", f"p{rng.randrange(30)}"]), rng.choice(["", f"http://{rng.choice(hosts)}/{rng.randrange(9)}"]), rng.choice(titles + [f"t{rank}"] * 6), "", day))
    df = spark.createDataFrame(rows, "execution string, rank int, provider_id string, url string, title string, site string, published date")
    want, chosen = {}, Counter()
    for execution in ("e1", "e2", "e3"):
        sources = []
        for _, rank, pid, url, title, _, day in (r for r in rows if r[0] == execution):
            keys = [(i, k) for i, k in enumerate((pid, url, "".join(c for c in title.lower() if c.isalnum()))) if k]
            at = next((s for k in keys for s in sources if k in s["keys"]), None)
            if at is None:
                at = {"keys": {}, "url": "", "day": None, "n": 0}
                sources.append(at)
            at["n"] += 1
            at["url"], at["day"] = at["url"] or url, at["day"] or day
            for k in keys:
                if not any(k in s["keys"] for s in sources):
                    at["keys"][k] = rank
        counts, hosts_seen, kept = Counter(raw=40, resolved=len(sources)), Counter(), 0
        for s in sources:
            if s["day"] and (dt.date(2024, 1, 1) - s["day"]).days > 365:
                counts["stale"] += 1
                continue
            host = s["url"].removeprefix("http://").split("/")[0]
            hosts_seen[host] += 1
            if hosts_seen[host] > 3:
                counts["site"] += 1
                continue
            kept += 1
            counts["capped" if kept > 15 else "selected"] += 1
        want[execution] = tuple(counts[c] for c in ("raw", "resolved", "stale", "site", "capped", "selected"))
        chosen.update(counts)
    marked = research.marked(research.resolved_sources(df), "2024-01-01")
    assert {r.execution: tuple(r)[1:] for r in research.funnel(marked).collect()} == want
    seen = research.write_sources(marked, f"file://{tmp_path}/sources")
    assert seen == {c: chosen[c] for c in ("raw", "resolved", "stale", "site", "capped", "selected")}
    assert spark.read.parquet(f"file://{tmp_path}/sources").count() == chosen["selected"]

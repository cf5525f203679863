"""Linkage candidates against all pairs."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.catalog import flows
from tidewell.functions import text, values
from tidewell.operators import ranking
from tidewell.plans import linkage
from tidewell.sources import shared

NOTICE = "id string, title string, number string, purchaser string, package string, published date, source_file string"
BUYERS = ["某某证券股份有限公司", "某某证券有限公司", "某某证券上海分公司", "乙证券", "乙证券有限公司", "丙丁基金管理", "戊"]


def _rows(prefix, n, rng, titles):
    out = []
    for i in range(n):
        title = rng.choice(titles)
        title = title if rng.random() < 0.6 else "".join(rng.choice("行情系统机房建设办公家具采购云平台数据") if rng.random() < 0.4 else c for c in title)
        day = None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(0, 500))
        number, package, file = rng.choice(["", "", f"P-{rng.randrange(30)}"]), rng.choice(["", "", "第一包", "包件02"]), rng.choice(["", "", "", f"f{rng.randrange(9)}"])
        out.append((f"{prefix}{i}", title, number, rng.choice(BUYERS), package, day, file))
    return out


def _company(a, b, x, y):
    if not x or not y:
        return 0.0
    if re.sub(text.SIGNS, "", a) == re.sub(text.SIGNS, "", b):
        return 1.0
    return 0.9 if x == y else 0.82 if len(x) >= 4 and y.startswith(x) or len(y) >= 4 and x.startswith(y) else 0.0


def _accepted(r, n):
    title = values.title_ratio(r.r_key_title, n.n_key_title)
    buyer = _company(r.r_purchaser, n.n_purchaser, r.r_key_buyer, n.n_key_buyer)
    number, package = r.r_key_number and r.r_key_number == n.n_key_number, r.r_package and r.r_package == n.n_package
    if r.r_published and n.n_published:
        if not 0 <= (r.r_published - n.n_published).days <= 180:
            return False
        return bool(number or r.r_source_file and r.r_source_file == n.n_source_file or title >= 0.45 or title >= 0.32 and buyer >= 0.82 or package and title >= 0.30)
    if r.r_key_number and n.n_key_number:
        return bool(number)
    return bool(title >= 0.9 and buyer >= 0.82 or package and title >= 0.92)


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(7)
    titles = ["".join(rng.choice("行情系统机房建设办公家具采购云平台数据") for _ in range(rng.randrange(4, 16))) for _ in range(12)] + ["", "行情", "Longer title of a data centre, with many words in it " * 5]
    return tuple(spark.createDataFrame(_rows(p, 150, rng, titles), NOTICE) for p in "rn")


def test_candidates_are_all_pairs_that_the_rule_accepts(frames):
    scored = linkage.candidates(*frames)
    left, right = (linkage._prepared(df, p).collect() for df, p in zip(frames, "rn", strict=True))
    want = {(r.r_id, n.n_id) for r in left for n in right if _accepted(r, n)}
    got = [tuple(p) for p in scored.select("r_id", "n_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


@pytest.mark.parametrize("top", [1, 5])
def test_top_keeps_the_best_of_each_result(frames, top):
    order, columns = [F.desc_nulls_last(c) for c in linkage.ORDER], ["r_id", "n_id", "score", "title", "purchaser"]
    every, some = linkage.candidates(*frames), linkage.candidates(*frames, top=top)
    best = [sorted(map(tuple, ranking.top_per_group(df, ["r_id"], order, top).select(*columns).collect())) for df in (every, some)]
    assert best[0] == best[1] and best[0]
    assert top > 1 or some.count() < every.count()


def test_the_query_s_titles_are_shared(spark):
    titles = flows._notices(spark, "/root/testdata/sf0.001", "O").groupBy("title").count()
    assert titles.count() <= 25 and titles.agg(F.max("count")).first()[0] > 10


def test_titles_meet_by_rare_characters(spark):
    """20,000 distinct titles: all near pairs of a sample of them are there, from a small part of all pairs."""
    rng = random.Random(11)
    signs, common = [chr(0x4E00 + i) for i in range(1500)], "系统项目采购"
    base = ["".join(rng.choice(signs) if rng.random() < 0.7 else rng.choice(common) for _ in range(rng.randrange(5, 18))) for _ in range(19_000)]
    base += ["".join(rng.choice(signs) if rng.random() < 0.3 else c for c in rng.choice(base)) for _ in range(1000)]
    titles = sorted(set(base))
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    rows = rows.withColumn("t", linkage._rarest_first(rows)("title")).repartition(8).cache()
    met = linkage.similar(rows, rows, [], 0.45).distinct().cache()
    assert met.count() < len(titles) ** 2 / 1000
    some = rng.sample(titles, 12) + base[-12:]
    want = {(a, b) for a in some for b in titles if values.title_ratio_from(a, b, 0.45) >= 0.45}
    got = {(r.a, r.b) for r in met.where(F.col("a").isin(some)).collect()}
    assert want <= got and len(want) > len(set(some))


def test_plans_stay_small(spark, monkeypatch):
    """The driver's memory goes by the plan that it has at a time: neither a step that is written nor the last one holds more than a few joins."""
    joins, written = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join "), linkage.written
    seen = []
    for module in (linkage, flows):
        monkeypatch.setattr(module, "written", lambda df, label: seen.append(joins(df)) or written(df, label), raising=False)
    seen.append(joins(flows.linkage_pipeline(spark, "/root/testdata/sf0.001")))
    assert max(seen) <= 6 and len(seen) > 5


def test_rows_are_not_sent_to_all_tasks(spark, monkeypatch):
    """What a join sends to all tasks the driver holds whole: it's tables of a few rows that their count tells, never one that Spark takes for small by its file."""
    seen, written, plan = [], linkage.written, lambda df: df._jdf.queryExecution()
    for module in (linkage, flows):
        monkeypatch.setattr(module, "written", lambda df, label: seen.append(df) or written(df, label), raising=False)
    sent = lambda: [n for df in seen for n in plan(df).executedPlan().toString().split("\n") if "BroadcastExchange" in n]
    monkeypatch.setattr(shared, "FEW", 0)
    seen.append(flows.linkage_pipeline(spark, "/root/testdata/sf0.001"))
    assert sent() == [] and len(seen) > 5 and sum(plan(df).optimizedPlan().toString().count("Join ") for df in seen) > 15
    few = written(spark.range(3), "few")
    monkeypatch.setattr(shared, "FEW", 3)
    assert [shared.met(df)._jdf.queryExecution().analyzed().toString().count("broadcast") for df in (few, few.union(few))] == [1, 0]

"""Releases of apps: which rows are one release, and what of their notes stays."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.plans import releases

SCHEMA = ", ".join(f"{c} string" for c in releases.RECORD) + ", feature_tags array<string>, highlights array<string>, extra string, id string, n long"


def row(**more):
    known = dict.fromkeys(releases.RECORD, "") | {"broker_name": "某券商", "app_name": "App", "feature_tags": [], "highlights": [], "extra": "e", "id": "i", "n": 1} | more
    return tuple(known[c] for c in (*releases.RECORD, "feature_tags", "highlights", "extra", "id", "n"))


@pytest.fixture(scope="module")
def fold(spark):
    return lambda rows, **more: releases.folded(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()


def test_low_value_notes_and_twins_go(fold):
    notes = [["新增 行情。", "md5：1"], ["新增行情", "下载", None, " "], ["优化体验"]]
    (r,) = fold([row(app_version="1", highlights=h, update_summary="欢迎您联系我们，修复", platform=p) for h, p in zip(notes, ("ipad", "ＩＯＳ", ""), strict=True)])
    assert (r.update_summary, r.highlights, r.platform, r.n_merged) == ("优化体验", ["新增 行情。"], "iOS", 3)


def test_versions_of_one_release(fold):
    same = ["v1.2", "版本号：V1.2", "１．２", "1. 2", "版本 1.2"]
    (r,) = fold([row(app_version=v, broker_name="海通证券", app_name=a) for v, a in zip(same, ("App", "ＡＰＰ", "app ", "- App", "APP"), strict=True)])
    assert r.release_key == "versioned|broker:国泰海通证券|app|1.2" and r.app_version == "1.2"
    assert len(fold([row(app_version="1", broker_code=" Ｇ T"), row(app_version="1", broker_code="gt", broker_name="x"), row(app_version="1")])) == 2
    assert not fold([]) and not fold([row(broker_name=None, app_name=None, app_version="1")])


def test_without_a_version(fold):
    day = {"publish_date": "2024-01-01", "source_url": "http://a.b"}
    assert len(fold([row(**day, content_sha256="AB"), row(**day, content_sha256="ab", update_summary="x")])) == 1
    assert len(fold([row(**day, update_summary="下载"), row(**day, update_summary="下载 2")])) == 2
    assert len(fold([row(**day, highlights=["a", "b"]), row(**day, highlights=["b", "a"])])) == 1
    assert len(fold([row(**day), row(**day | {"publish_date": "2024-01-02"}), row(**day, platform="ios"), row(**day | {"source_url": "http://localhost/"})])) == 4


def test_representative_type_and_latest(fold):
    rows = [
        row(app_version="1", update_summary="修复问题", update_type="问题修复", publish_date="2024-01-03", crawl_time="c1", source_url="http://z.z"),
        row(app_version="1", update_summary="新增行情并优化体验", update_type="甲", publish_date="2024-01-02", crawl_time="c2", content_sha256="S", feature_tags=["b", " a"]),
        row(app_version="1", update_summary="下载", update_type="新功能", publish_date="soon", crawl_time="c9", feature_tags=["a", ""]),
    ]
    (r,) = fold(rows)
    assert (r.update_summary, r.update_type, r.publish_date, r.crawl_time, r.content_sha256, r.source_url) == ("新增行情并优化体验", "问题修复", "2024-01-03", "c1", "S", "http://z.z")
    assert r.feature_tags == ["a", "b"] and r.search_text.startswith("某券商\n\napp\n1\n新增") and len(r.id) == 68
    (r,) = fold([row(app_version="1", update_type="新功能", update_summary="下载")])
    assert (r.update_type, r.update_summary, r.highlights, r.publish_date) == ("其他", "", [], "")


def test_most_highlights(fold):
    (r,) = fold([row(app_version="1", highlights=[f"新增功能{i}" for i in range(20)]) for _ in range(30)], most=3)
    assert r.update_summary == "新增功能0" and r.highlights == ["新增功能1", "新增功能10", "新增功能11"]


def shown_score(text):
    text = " ".join((text or "").split())
    if not text or text.startswith(("md5：", "支持iOS 1")) or "股票交易平台" in text:
        return -100
    return min(len(text), 120) / 30 + 8 * any(w in text for w in ("新增", "优化", "修复")) + any(c.isdigit() for c in text)


def test_client_fold_equals_plain_python(spark):
    rng = random.Random(3)
    notes = ["新增行情", " 新增  行情", "优化体验 2", "md5：1", "股票交易平台优化", "一般说明", "修复", "", "支持iOS 12 起"]
    rows = []
    for i in range(150):
        version = rng.choice(["", "v 1", "1", "V2", "版本3"])
        rows.append(row(
            id=f"r{i:03}", app_version=version, broker_code=rng.choice(["", "C "]), broker_name=rng.choice(["A", "a"]), platform=rng.choice(["iOS", "Android", "未知", ""]), update_summary=rng.choice(notes),
            highlights=rng.sample(notes, 4), feature_tags=rng.sample(["x", "y", "z"], 2), publish_date=rng.choice(["", "2024-01-01", "2024-01-02"]), update_type=str(i),
        ))
    df = spark.createDataFrame(rows, SCHEMA)
    groups = defaultdict(list)
    for r in df.collect():
        version = r.app_version.strip().lower().removeprefix("v").strip()
        key = f"versioned:{(r.broker_code or r.broker_name).strip().lower()}||app||{version}" if version else f"unversioned:{r.id}"
        groups[key].append(r)
    want = {}
    for key, held in groups.items():
        top = min(held, key=lambda r: (-shown_score(r.update_summary), -max(0, *map(shown_score, r.highlights)), tuple(-ord(c) for c in r.publish_date) or (0,), r.id))
        good = [r for r in held if shown_score(r.update_summary) > -100]
        summary = min(good, key=lambda r: (-shown_score(r.update_summary), r.id)).update_summary if good else ""
        told = {" ".join(h.split()) for r in held for h in r.highlights if shown_score(h) > -100} - {summary}
        platforms = {r.platform for r in held} - {"未知", ""}
        want[key] = (
            top.update_type, summary, sorted(told, key=lambda h: (-shown_score(h), h))[:5], "全平台" if len(platforms) > 1 else min(platforms, default=top.platform or "未知"),
            sorted({t for r in held for t in r.feature_tags}), max(r.publish_date for r in held), len(held),
        )
    got = {r.id: (r.update_type, r.update_summary, r.highlights, r.platform, r.feature_tags, r.publish_date, r.n_merged) for r in releases.shown_folded(df.withColumn("n_merged", F.lit(1))).collect()}
    assert got == want

"""Domains, tags and notes of notices against plain definitions."""

import random

from pyspark.sql import functions as F

from tidewell.catalog.notices import _classified
from tidewell.functions.keywords import Dictionary, longest_at_each_place
from tidewell.plans import notices


def test_dictionary_finds_every_table(spark):
    rng = random.Random(1)
    letters = "ab.c("
    words = lambda n: tuple({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(n)})
    tables = {f"t{i}": words(rng.randrange(1, 6)) for i in range(40)}
    known = Dictionary(tables)
    texts = ["".join(rng.choice(letters + "x") for _ in range(rng.randrange(12))) for _ in range(200)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", known.mask(F.col("t")))
    for r in df.collect():
        assert r.m == sum(known.bit[name] for name, held in tables.items() if any(w in (r.t or "") for w in held))
    assert longest_at_each_place(["a", "ab"]) == "(?=((?:a(?:b)?)))"


def test_every_decision_falls(spark):
    rows = _classified(spark, "/root/testdata/sf0.01").groupBy("step").count().collect()
    # words of capital markets are words of a business too, and systems are objects, so that step never comes first
    assert {r.step for r in rows} == set(notices.STEPS) - {"named capital"}


def test_decisions_of_nulls_and_precedence(spark):
    rows = [
        (None, None, None, None, None, "none"), ("交易系统升级", None, None, "工程建设与装修", None, "business"), ("柜台办公软件", "", "", "", True, "excluded"), ("负载均衡采购", "", "", "", True, "broker"),
        ("负载均衡采购", "", "", "", False, "none"), ("负载均衡采购", "", "", " IT软硬件", None, "category"), ("运维平台", "", "", "", None, "named"), ("餐饮", "", "大模型", "", None, "other"), ("", "", "大模型", "", None, "domain"),
        ("", "", "投行", "系统", None, "capital"), ("广告投放系统", "", "", "", True, "excluded"), ("财富管理广告系统", "", "", "", None, "business"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "title string, scope string, sub string, category string, is_broker boolean, want string, i int")
    for r in notices.domains(df, "title", "scope", "sub", "category", "is_broker").collect():
        assert r.step == r.want, r
        assert r.is_fintech == (r.step not in ("excluded", "other", "none"))


def test_notes_of_odd_lines(spark):
    text = "新增A功能\r\n新增A功能\r- 1. 优化首页 https://a.b/c ；\n\n# 新增标题\n更新说明：\n" + "优化" + "长" * 300 + "\x0b看点与复盘\n版本：9\nv1.2 V1.2 version 3.4.5\n发布日期：2024.1.9"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    told = [r.p for r in df.select(notices.prepared_content(F.col("t")).alias("p")).collect()]
    assert told[1:] == ["", ""]
    lines = told[0].split("\n")
    assert lines[:3] == ["版本证据：1.2、3.4.5", "日期证据：2024-01-09", "新增A功能"] and "官方更新说明候选：看点与复盘" in lines
    # a line is cut to 240 characters, whole lines are compared with what is left of them
    assert lines.count("新增A功能") == 1 and max(map(len, lines)) == 240 + len("官方更新说明候选：") and not any(x.endswith("更新说明：") or x.startswith("#") for x in lines)
    fields = df.select(notices.update_fields(notices.meaningful_lines(F.col("t"))).alias("f")).collect()
    assert fields[1].f.update_type == "其他" and fields[1].f.feature_tags == ["其他"] and fields[0].f.update_type == "新功能"

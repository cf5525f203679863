"""Reports in all their shapes."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.plans import reports

FACT = {"type": "fact", "text": "a &lt;b&gt;x&lt;/b&gt; <i>y</i> see http://a.com/p?utm_source=q and http://evil.com/x.", "source_ids": ["1", "[2]", "9", " ", "1"]}


@pytest.fixture(scope="module")
def told(spark):
    answers = {
        "v2": json.dumps({"title": "T <b>x</b>", "core_judgment": FACT, "key_developments": [{"summary": "s", "source_ids": ["s2"]}, "no source", {"type": "odd", "text": "t", "source_ids": ["8"]}, 5], "impact_analysis": {"items": [{"type": " Recommendation", "title": "do"}]}, "company_implications": "only text", "risks_and_watch_items": []}),
        "old": "```json\n" + json.dumps({"core_conclusion": [{"text": "c", "source_ids": ["1"]}], "key_dynamics": {"text": "k", "source_ids": ["[2]"]}, "focus_sections": [], "risks": ["r1", ""], "watch_items": ["w1", "w2"]}) + "\n```",
        "empty": '{"title": "x", "core_judgment": []}', "uncited": json.dumps({"core_judgment": [{"type": "recommendation", "text": "r"}]}), "text": "no JSON", "list": "[1]",
        "many": json.dumps({"core_judgment": [{"text": f"i{i}", "source_ids": ["1"]} for i in range(40)], "key_developments": [{"text": "x", "source_ids": [f"u{i}"]} for i in range(50)]}), "null": None,
    }
    rows = spark.createDataFrame(list(answers.items()), "execution string, answer string")
    sources = spark.createDataFrame([(e, s, u) for e in answers for s, u in (("1", "http://a.com/p"), ("s2", ""))], "execution string, source_id string, url string")
    aliases = spark.createDataFrame([(e, "[2]", "s2") for e in answers], "execution string, alias string, source_id string")
    states, items = reports.normalized(rows, sources, aliases)
    got = {}
    for r in items.collect():
        got.setdefault(r.execution, {}).setdefault(r.section, []).append((r.place, r.type, r.text, r.source_ids))
    return {r.execution: r for r in states.collect()}, {e: {s: sorted(x) for s, x in held.items()} for e, held in got.items()}


def test_sections_and_citations(told):
    states, items = told
    assert states["v2"].error is None and states["v2"].title == "T x"
    assert items["v2"]["core_judgment"] == [(1, "fact", "a x y see http://a.com/p?utm_source=q and [未核验链接]", ["1", "s2"])]
    assert items["v2"]["key_developments"] == [(1, "fact", "s", ["s2"])]
    assert items["v2"]["impact_analysis"] == [(1, "recommendation", "do", [])] and "company_implications" not in items["v2"]
    assert states["v2"].warnings == ["未找到引用来源：9", "存在未引用来源的事实或分析项", "未找到引用来源：8"]


def test_older_names(told):
    states, items = told
    assert states["old"].error is None and states["old"].title == reports.TITLE
    assert items["old"] == {
        "core_judgment": [(1, "analysis", "c", ["1"])], "key_developments": [(1, "fact", "k", ["s2"])], "risks_and_watch_items": [(1, "recommendation", "w1", []), (2, "recommendation", "w2", [])],
    }


def test_errors_and_limits(told):
    states, items = told
    assert {e: r.error for e, r in states.items() if r.error} == {
        "empty": reports.NO_CONTENT, "uncited": reports.NO_GROUND, "text": reports.NO_JSON, "list": reports.NO_JSON, "null": reports.NO_JSON,
    }
    assert set(items) == {"v2", "old", "many"}
    assert [t for _, _, t, _ in items["many"]["core_judgment"]] == [f"i{i}" for i in range(30)]
    assert len(states["many"].warnings) == 30 and states["many"].warnings[0] == "未找到引用来源：u0"


def test_cleaned_text(spark):
    odd = [("a\x00b\x07c\td", 99, "abc\td"), ("\u3000 x\xa0", 99, "x"), ("&lt;b&gt;x&amp;lt;", 99, "x&lt;"), (None, 9, ""), ("abc", 2, "ab"), ("1 <2> 3", 99, "1 <2> 3"), ("```JSON\n{}```", 99, "{}")]
    for text, most, want in odd:
        assert spark.createDataFrame([(text,)], "t string").select(reports.clean_text(F.col("t"), most)).first()[0] == want

"""Operators on small literal rows: ties, blanks, boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text, values
from tidewell.operators import facets, gates, keyed, links, ranking
from tidewell.plans import linkage, releases, research

D = dt.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_window_is_inclusive_and_looks_back_only(spark):
    r = spark.createDataFrame([("r", D(2024, 7, 1)), ("u", None)], "r string, rd date")
    n = spark.createDataFrame([("same", D(2024, 7, 1)), ("last", D(2024, 1, 3)), ("over", D(2024, 1, 2)), ("after", D(2024, 7, 2)), ("undated", None)], "n string, nd date")
    assert rows(links.range_candidates(r, n, "rd", "nd", []).select("n", "gap_days")) == [("last", 180), ("same", 0)]


@pytest.mark.parametrize(("gap", "score"), [(None, 0.5), (-1, 0.0), (0, 1.0), (45, 1.0), (46, 0.75), (120, 0.75), (240, 0.45), (241, 0.15)])
def test_date_gap(spark, gap, score):
    assert one(spark, links.date_gap_score, gap, "int") == score


@pytest.mark.parametrize(("best", "second", "verdict"), [(0.9, 0.82, "matched"), (0.9, 0.8201, "conflict"), (0.82, 0.0, "matched"), (0.62, 0.0, "review"), (0.6199, 0.0, "unmatched")])
def test_margin(spark, best, second, verdict):
    df = spark.createDataFrame([("r", "a", best), ("r", "b", second)], "r string, n string, s double")
    got = ranking.with_margin(df, ["r"], [F.desc("s"), F.desc("n")], "s").first()
    assert (got["n"], got["verdict"]) == ("a", verdict) and got["margin"] == pytest.approx(best - second, abs=1e-9)


def test_validation_names_the_first_broken_rule(spark):
    schema = "result_id string, notice_id string, status string, conflict boolean, decision string, candidate_id string, confidence string"
    ok = ("r", "n", "auto_matched", False, "matched", "n", "0.95")
    change = lambda i, v: tuple(v if k == i else x for k, x in enumerate(ok))
    cases = {
        None: ok, "invalid_input": change(1, None), "not_auto_matched": change(2, "needs_review"), "hard_conflict": change(3, True), "llm_decision_mismatch": change(4, "unmatched"),
        "candidate_id_mismatch": change(5, "m"), "confidence_below_threshold": change(6, "0.9499"), "missing_result_record": change(0, "gone"),
    }
    cases["missing_procurement_record"] = ("r", "m", "auto_matched", False, "matched", "m", "1")
    ids = lambda c, v: spark.createDataFrame([(v,)], f"{c} string")
    got = links.validated(spark.createDataFrame(list(cases.values()), schema), ids("result_id", "r"), ids("notice_id", "n"))
    assert sorted(str(r["reason"]) for r in got.collect()) == sorted(map(str, cases))


def test_upsert_pick_and_changes(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    live = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert rows(keyed.upsert(base, live, ["k"])) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(keyed.pick(base.union(live), ["k"], [F.col("v")])) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(keyed.replace_groups(base, live.limit(0), "k", base.where("k = 'a'"))) == [("b", 2)]
    old = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3"), ("d", "4")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "9"), ("e", "5")], "k string, h string")
    assert rows(keyed.changes(old, new, "k", "h")) == [("a", "unchanged"), ("b", "changed"), ("c", "changed"), ("d", "gone"), ("e", "new")]


def test_group_hash_ignores_order(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1)], "k string, v int")
    h = {r.k: r.digest for r in keyed.group_hash(df, ["k"], ["v"]).collect()}
    assert h["a"] == h["b"] != h["c"]


def test_multi_key_takes_the_first_level(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, "", "q"), (3, "z", "")], "id int, a string, b string")
    right = spark.createDataFrame([(7, "x", "q"), (8, "", "p"), (9, "", "")], "id int, a string, b string")
    got = keyed.multi_key_matches(left, right, {"a": F.col("a"), "b": F.col("b")}, "id", "id")
    assert rows(got) == [(1, "a", 7), (2, "b", 7)]


def test_caps_pages_and_facets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 > 0]) for i in range(12)], "i int, g string")
    assert [r.i for r in ranking.capped(df, "g", [F.col("i")], 2, 3).collect()] == [0, 1, 2]
    last = ranking.page(df, [F.col("i")], 99, 5).collect()
    assert [r.i for r in last] == [10, 11] and last[0].total_pages == 3
    assert ranking.page(df.limit(0), [F.col("i")], 4, 5).count() == 0
    assert rows(facets.zero_filled(df, "g", ["a", "c"], "other")) == [("a", 4), ("c", 0), ("other", 8)]
    counts = spark.createDataFrame([(f"n{i}", 10 - i) for i in range(9)], "name string, n long")
    folded = {r.name: r.n for r in facets.folded_tail(counts, "name", "n", 8, 7, "other").collect()}
    assert len(folded) == 8 and folded["other"] == 5
    assert facets.folded_tail(counts.limit(8), "name", "n", 8, 7, "other").count() == 8
    assert df.where(facets.contains_literal(["g"], "%")).count() == 0
    assert df.where(facets.conjunction([None, F.col("i") > 9])).count() == 2


def test_gates(spark):
    five, two, none = spark.range(5), spark.range(2), spark.range(0)
    assert not gates.may_publish(two, five) and gates.may_publish(spark.range(3), five) and not gates.may_publish(none, none)
    assert not gates.failure_gate(1, 2) and gates.failure_gate(1, 3) and not gates.failure_gate(0, 0)
    assert gates.same_rows(five, five) and not gates.same_rows(five, two)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.strip_suffixes, "某系统采购项目（中标公告）", "某系统采购项目（中标公告）"),
        (text.strip_suffixes, "（某系统）中标公告", "某系统"),
        (text.strip_suffixes, "某系统 招标公告 取消公告", "某系统"),
        (text.project_key, "关于某系统采购的 招标公告", "某系统采购"),
        (text.number_key, "ab－01/2（x）", "AB012X"),
        (text.company_short, "某某证券股份有限公司", "某某"),
        (text.chinese_number, "十", 10),
        (text.chinese_number, "二十三", 23),
        (text.chinese_number, "007", 7),
        (text.chinese_number, "百", None),
        (text.package_number, "项目第二包", 2),
        (text.package_number, "标段12", 12),
        (text.package_number, "项目", None),
        (text.package_number, "一包", 1),
        (text.package_number, "二标段", 2),
        (text.package_number, "包件03", 3),
        (text.package_number, "第两包", 2),
        (text.package_number, "000包", 0),
        (text.package_number, "2024包", 24),
        (text.package_number, "标段 三十一", 31),
        (text.package_number, "零一包", None),
        (text.chinese_number, "两", 2),
        (text.chinese_number, "十十", 20),
        (text.chinese_number, "九十〇", 90),
        (text.markdown_title, "x\n#  A b \ny", "A b"),
        (text.nfkc, " ＡＢ①", "AB1"),
        (text.portable_name, 'a/b:c"d', "a_b_c_d"),
        (values.first_date, "于2024年3月5日发布", D(2024, 3, 5)),
        (values.first_date, "2024-02-30", None),
        (values.compact, "1.5", "1.5"),
        (values.compact, "2", "2"),
        (values.host, "https://www.A.com:80/x", "a.com"),
        (values.canonical_url, "HTTP://www.A.com:80/x/?b=2&utm_source=q&a=1#f", "http://a.com/x?a=1&b=2"),
        (values.canonical_url, "no address", None),
        (values.is_public_url, "http://u:p@a.com/", False),
        (values.is_public_url, "http://localhost/x", False),
        (values.is_public_url, "https://a.com", True),
        (values.tri_state, " 是", True),
        (values.tri_state, "maybe", None),
        (values.json_strings, '["a","b"]', ["a", "b"]),
        (values.json_strings, "a", ["a"]),
        (values.json_strings, " ", []),
        (values.html_text, "<p>a&amp;b</p><script>x</script><ul><li>c</ul>", "a&b\n- c"),
        (values.unescaped, "&lt;x&gt;", "<x>"),
        (releases.version_key, "版本号：V 1.2", "1.2"),
        (releases.version_key, " 版本 Ｖ１．２ b", "1.2b"),
        (releases.platform, "ＩＯＳ", "iOS"),
        (releases.platform, "i pad", "iOS"),
        (releases.platform, "苹果", "iOS"),
        (releases.platform, "H5", "Web"),
        (releases.platform, " 电 视", "电 视"),
        (releases.platform, None, "未知"),
        (releases.broker, " 国泰 君安", "国泰海通证券"),
        (releases.package_url, "http://a.b/-/app/x", ""),
        (releases.package_url, "http://a.b/app/x", "http://a.b/app/x"),
        (releases.package_date, "2024年3月1日", "2024-03-01"),
        (releases.package_date, "2024-01-01T00:30:00+08:00", "2023-12-31"),
        (releases.platform, "iPhone", "iOS"),
        (releases.platform, " ", "未知"),
        (releases.low_value, "下载：1.2", True),
        (releases.low_value, "优化登录体验", False),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


def test_amounts_and_json(spark):
    amount = lambda v: one(spark, values.amount_with_units, v)
    assert str(amount("-5万")) == "-50000.00" and str(amount("约5.2（亿元）")) == "520000000.00" and amount(None) is None
    assert str(amount("约1,234.5万元")) == "12345000.00" and str(amount("2亿")) == "200000000.00" and amount("无") is None
    df = spark.createDataFrame([("1,000", "inf", "-1", "3")], "a string, b string, c string, d string")
    assert df.select(values.positive_amount(*[F.col(c) for c in "abcd"])).first()[0] == 3.0
    said = lambda v: one(spark, lambda c: values.outermost_json(c).cast("string"), v)
    assert said('```json\n{"a":1}\n```') == '{"a":1}' and said('so: {"a":[1]} end') == '{"a":[1]}' and said("none") is None
    assert values.title_ratio("ab", "xaby") == 0.92 and values.title_ratio("", "a") == 0.0 and values.title_ratio("a", "a") == 1.0


def test_front_matter(spark):
    meta = one(spark, text.front_matter, "---\ntitle: 'A: b'\nid: 7\nid: 8\nodd line\n---\n# T")
    assert meta == {"title": "A: b", "id": "7"}
    assert one(spark, text.front_matter, "# T") == {}


NOTICE = "id string, title string, number string, purchaser string, package string, published date, source_file string"


def test_linkage_end_to_end(spark):
    notices = spark.createDataFrame(
        [
            ("n1", "行情系统采购公告", "P-001", "某某证券股份有限公司", "", D(2024, 1, 1), ""), ("n2", "行情系统二次采购公告", "P-009", "某某证券股份有限公司", "", D(2024, 1, 2), ""),
            ("n3", "机房建设招标公告", "", "乙证券有限公司", "", None, ""), ("n4", "办公家具采购公告", "P-004", "丙公司", "", D(2020, 1, 1), ""),
        ],
        NOTICE,
    )
    results = spark.createDataFrame(
        [
            ("r1", "行情系统中标公告", "P－001", "某某证券股份有限公司", "", D(2024, 3, 1), ""), ("r3", "机房建设中标公告", "", "乙证券有限公司", "", D(2024, 5, 1), ""),
            ("r4", "办公家具成交公告", "P-004", "丙公司", "", D(2024, 1, 1), ""),
        ],
        NOTICE,
    )
    scored = linkage.candidates(results, notices)
    top, best = linkage.matched(scored)
    pairs = {(r.r_id, r.n_id) for r in top.collect()}
    assert ("r1", "n1") in pairs and ("r3", "n3") in pairs and not any(r == "r4" for r, _ in pairs)
    final = {r.r_id: (r.n_id, r.status) for r in linkage.decided(best, linkage.asked(best), linkage.asked(best)).collect()}
    assert final["r1"] == ("n1", "auto_matched")
    broken = linkage.asked(best, lambda: (_ for _ in ()).throw).where("error IS NOT NULL").count()
    assert broken == best.count()
    out = linkage.merged(notices, results, spark.createDataFrame([("r1", "n1")], "r_id string, n_id string"))
    got = {r.id: (r.kind, r.n_results) for r in out.collect()}
    assert got["n1"] == ("notice", 1) and got["n4"] == ("notice", 0) and got["r4"] == ("result", None) and "r1" not in got
    cache = spark.createDataFrame([], "pair_hash string, decision string, confidence double, error string")
    answers, fresh = linkage.asked_once(best, cache, "v1")
    assert fresh.count() == best.count() == answers.where("decision IS NOT NULL").count()
    assert linkage.asked_once(best, fresh, "v1")[1].count() == 0


def test_reuse(spark):
    results = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1"), ("e", "1")], "id string, content_hash string")
    state = spark.createDataFrame([("a", "1", "auto_matched", "n", "h"), ("b", "1", "auto_matched", "m", "old"), ("c", "1", "auto_unmatched", None, None), ("d", "1", "auto_unmatched", None, None)], "id string, old_hash string, status string, n_id string, n_hash string")
    notices = spark.createDataFrame([("n", "h"), ("m", "new")], "n_id string, hash string")
    assert rows(linkage.reusable(results, state, notices)) == [("a", "stable_matched"), ("b", "reprocess"), ("c", "reprocess"), ("d", "stable_unmatched"), ("e", "reprocess")]


def test_sources_join_the_first_that_agrees(spark):
    schema = "execution string, rank int, provider_id string, url string, title string, site string, published date"
    df = spark.createDataFrame(
        [("e", 1, "p1", "http://a.com/x", "One", "", None), ("e", 2, "p2", "http://b.com/", "Two", "B", D(2020, 1, 1)), ("e", 3, "p1", "http://c.com/", "two!", "C", D(2024, 1, 1)), ("e", 4, "", "http://www.b.com", "", "", None)],
        schema,
    )
    out = {r.source_id: r for r in research.resolved_sources(df).collect()}
    assert len(out) == 2 and out[0].site == "C" and out[0].n_merged == 2 and out[1].n_merged == 2
    assert [r.source_id for r in research.selected(research.resolved_sources(df), "2024-02-01").collect()] == [0]
    items = spark.createDataFrame([("i", "fact", ["1", "9"]), ("j", "fact", ["9"]), ("k", "recommendation", [])], "item_id string, kind string, source_ids array<string>")
    got = {r.item_id: r.source_ids for r in research.grounded(items, spark.createDataFrame([("1",)], "source_id string")).collect()}
    assert got == {"i": ["1"], "k": []}

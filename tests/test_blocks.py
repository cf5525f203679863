"""Nodes of pages, and the parsers over them."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.sources import blocks

PAGE = """<html><body><script>var x = "<h2>更新说明</h2>";</script><div id=a><h2> 更新 <b>说明</b></h2><p>新增&amp;优化</p>
<ul><li>一<li>二</ul><h3>小节</h3>文字<h2>用户评论</h2><p>好</p></div><h1>更新 说明</h1><p>不是它</p><h4>最后</h4><p>末尾<svg><p>x</p></svg></body></html>"""


class Texts(HTMLParser):
    def __init__(self, page):
        super().__init__()
        self.out = []
        self.feed(page)
        self.close()

    def handle_data(self, data):
        self.out.append(data)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (3, "", "z"), (4, "<h2>更新 说明</h2>", "w")], "page long, body string, text string")


def test_nodes_of_broken_pages():
    rng = random.Random(2)
    parts = ["<div class='a b'>", "</div>", "<p>", "</p>", "<br>", "<br/>", "<li id=i>", "</ul>", "text\n", " ", "&amp;", "<", "</", "<!-- c -->", "<b/>", "é"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        found = blocks._Nodes(page).found
        assert [x["n"] for x in found] == list(range(len(found)))
        assert "".join(x["text"] for x in found if x["tag"] == "#text") == "".join(Texts(page).out)
        for x in found:
            assert 0 <= x["begin"] <= x["close"] <= x["end"] <= len(page)
            inside = [y["n"] for y in found if x["n"] in y["path"]]
            assert inside == list(range(x["n"] + 1, x["last"] + 1))
            assert x["parent"] == (x["path"][-1] if x["path"] else None) and x["depth"] == len(x["path"])


def test_sections(pages):
    got = {(r.page, r.heading): (r.content, r.error) for r in blocks.sections(pages, "page", "body", [" 更新 说明", "小节", "最后", "没有"]).collect()}
    assert got[1, "更新 说明"] == ("新增&优化\n\n- 一\n- 二\n\n### 小节\n\n文字", None) or got[1, "更新 说明"][0].startswith("新增&优化") and "用户评论" not in got[1, "更新 说明"][0]
    assert got[1, "小节"][0] == "文字" and got[1, "最后"][0] == "末尾"
    assert got[4, "更新 说明"] == (blocks.EMPTY, None)
    assert len(got) == 16 and all(got[p, h][1] == f"no heading {h}" for p in (2, 3) for h in ("小节", "没有"))


def test_downloads(spark):
    card = lambda app, day, intro: f"<li><h3>{app}</h3><span>{day}更新</span> <i>软件介绍：</i>{intro}<a>IOS下载</a> <a>安卓下载</a></li>"
    body = f"<div><div>{card('甲App', '2024-01-02 ', '很好')}{card('乙', '2024-02-03', '')}<li>丙 软件介绍：没有日期</li></div><div>软件介绍：甲App 2024-01-01更新</div></div>"
    df = spark.createDataFrame([(1, body), (2, None)], "k long, body string")
    got = {(r.k, r.app): (r.released, r.platforms, r.introduction, r.error) for r in blocks.downloads(df, "k", "body", ["甲App", "乙", "丁"]).collect()}
    assert got[1, "甲App"] == ("2024-01-02", "iOS、Android", "很好", None) and got[1, "乙"] == ("2024-02-03", "iOS、Android", blocks.EMPTY, None)
    assert got[1, "丁"][3] == "no app 丁" and got[2, "乙"][3] == "no app 乙" and len(got) == 6


def test_cards(spark):
    card = lambda name, text: f"<div class='card x'><p class=name>{name}</p><p class=name>别名</p><div class=body>{text}</div></div>"
    body = card("易 淘 金", "<p>第一</p><p>版本：1</p><p>苹果版：a 安卓版：b</p>") + card("易淘金 二", "第二") + "<div class=card>空</div>" + "<section class=card><p class=name>别名</p></section>"
    df = spark.createDataFrame([(1, body), (2, "")], "k long, body string")
    got = {(r.k, r.app): (r.content, r.error) for r in blocks.cards(df, "k", "body", ["易淘金", "别名", "无"], ".card", "p.name", ".body", ["版本", "苹果版："]).collect()}
    assert got[1, "易淘金"] == ("第一\n\n安卓版：b", None) and got[1, "别名"] == (None, "no content for 别名") and got[1, "无"][1] == got[2, "无"][1] == "no app 无"
    whole = {r.app: r.content for r in blocks.cards(df.where("k = 1"), "k", "body", ["易淘金 二"], "div.card", ".name").collect()}
    assert "第二" in whole["易淘金 二"] and "易淘金" in whole["易淘金 二"]
    with pytest.raises(ValueError):
        blocks.matches(df.withColumns({"tag": F.lit(""), "classes": F.array(), "id": F.lit("")}), "div > p")


def test_articles(spark):
    page = "<div class='so-download-cont x'><h2>粤 <b>APP</b></h2>2024-01-01\n 更新<p>修复</p><a href=' http://x/a.APK '>立即下载</a><a href='http://x/a.APK'>再来</a></div><div class='so-download-cont'><h2>电脑版</h2><a href='b.apk'>x</a></div><div class='so-download-cont'><h2>手机</h2><a href='b.exe'>x</a></div><div class='so-download-cont'><a href='c.apk'>手机</a></div>"
    bodies = {"a": json.dumps({"data": {"records": [{"content": page}, {"content": ""}, {}, {"content": "<div class='so-download-cont'><h2>安卓</h2><a href='d.apk'>点击下载</a></div>"}]}}), "b": "{", "c": '{"data": {"records": []}}', "d": json.dumps({"data": {"records": [{"content": "<p>x</p>"}]}}), "e": None}
    df = spark.createDataFrame(list(bodies.items()), "source string, body string")
    got = {(r.source, r.app): (r.content, r.error) for r in blocks.articles(df, "source", "body").collect()}
    assert got == {
        ("a", "粤 APP"): ("2024-01-01\n更新\n修复\n再来\n\n- 下载：http://x/a.APK", None), ("a", "安卓"): ("- 下载：d.apk", None), ("b", None): (None, "unreadable body"),
        ("c", None): (None, "no records"), ("d", None): (None, "no mobile app"), ("e", None): (None, "unreadable body"),
    }


def test_decoded_front_matter(spark):
    document = '---\ntitle: "a \\"b\\" \\u4e2d"\nn: 12\nf: 1.5\nb: true\nz: null\nq: \'single\'\nurl: http://a.b/c\n no key\n: x\nlist: [1]\nn: 13\n---x\nbody: y\n---\n'
    df = spark.createDataFrame([(document,), ("x\n---\na: b\n---\n",), (None,), ("---\na: b",)], "d string")
    loose = [r.m for r in df.select(text.decoded_front_matter(F.col("d")).alias("m")).collect()]
    assert loose[0] == {"title": 'a "b" 中', "n": "13", "f": "1.5", "b": "True", "z": "", "q": "single", "url": "http://a.b/c", "list": "[1]"}
    assert not loose[1] and not loose[2] and not loose[3]
    strict = df.select(text.decoded_front_matter(F.col("d"), strict=True).alias("m")).first().m
    assert strict["body"] == "y" and strict["title"] == 'a "b" 中'

"""Parsers of HTML pages over a table of their nodes: heading sections, smallest blocks, first cards.

``nodes`` gives a page's elements and texts as rows; what a parser looks for is then joined
from them by page, with intervals of document order telling what lies in what. A page that lacks what was asked for
gives a row with the error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import markup

NODE = "struct<n:int,last:int,depth:int,parent:int,path:array<int>,tag:string,id:string,href:string,classes:array<string>,begin:int,close:int,end:int,text:string>"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REMOVED = frozenset(("script", "style", "noscript", "svg", "canvas"))
#: Headings that end a section, what stands for an empty one, marks of a download's block, words of an app's name, labels of buttons.
EXCLUDED_HEADINGS = ("用户评论", "如何在电脑上下载并使用", "你可能还喜欢", "厂商其他应用", "热门分类", "网友热搜")
EMPTY, INTRODUCTION = "（页面未提供内容）", "软件介绍："
DATED = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\s*更新"
BUTTONS = r"(?:\s*(?:点击立即下载|立即下载|IOS下载|android下载|安卓下载))+\s*$"

MOBILE = ("APP", "app", "安卓", "手机", "苹果", "iOS", "IOS", "Android")
LABELS = ("点击立即下载", "立即下载", "点击下载")


class _Nodes(HTMLParser):
    """Elements with their place in the source, in document order; a text is a node #text; what lies in REMOVED is left out."""

    def __init__(self, page: str):
        super().__init__()
        self.page, self.found, self.stack = page, [], []
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.removed = 0
        self.feed(page)
        self.close()
        while self.stack:
            self._end(len(page), len(page))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _add(self, tag: str, attrs: dict, begin: int, end: int, text: str | None = None) -> dict:
        path = [x["n"] for x in self.stack]
        node = {
            "n": len(self.found), "last": len(self.found), "depth": len(path), "parent": path[-1] if path else None, "path": path, "tag": tag, "id": attrs.get("id") or "", "href": (attrs.get("href") or "").strip(),
            "classes": (attrs.get("class") or "").split(), "begin": begin, "close": end, "end": end, "text": text,
        }
        self.found.append(node)
        return node

    def _end(self, close: int, end: int) -> str:
        node = self.stack.pop()
        node.update(last=len(self.found) - 1, close=close, end=end)
        self.removed -= node["tag"] in REMOVED
        return node["tag"]

    def handle_starttag(self, tag, attrs):
        begin = self._at()
        end = begin + len(self.get_starttag_text() or "")
        node = self._add(tag, dict(attrs), begin, end)
        if tag not in VOID:
            self.stack.append(node)
            self.removed += tag in REMOVED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(self._at(), self.found[-1]["end"])

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.stack):
            close = self._at()
            end = self.page.find(">", close) + 1 or len(self.page)
            while self._end(close, end if self.stack[-1]["tag"] == tag else close) != tag:
                pass

    def handle_data(self, data):
        if not self.removed:
            at = self._at()
            self._add("#text", {}, at, at + len(data), data)


def _nodes(pages: pd.Series) -> pd.Series:
    return pd.Series([[x for x in _Nodes(p or "").found if x["tag"] not in REMOVED] for p in pages])


def nodes(pages: DataFrame, key: str, body: str) -> DataFrame:
    """key, body's nodes: n (place in document order), last (the last node inside), depth, parent, path (nodes around it), tag, id, href, classes, begin, close, end (places in the source), text."""
    found = F.pandas_udf(_nodes, f"array<{NODE}>")(F.col(body))
    return pages.select(key, F.explode(found).alias("_x")).select(key, "_x.*")


def texts(found: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """wanted (rows of found) with text: what lies in them, stripped, in order, a space between."""
    leaf = found.where("tag = '#text'").select(key, "n", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("t"), F.explode("path").alias("a")).where("t <> ''")
    parts = F.sort_array(F.collect_list(F.struct("n", "t")))
    held = leaf.join(wanted.select(key, F.col("n").alias("a")), [key, "a"]).groupBy(key, "a").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("_t"))
    return wanted.drop("text").join(held.withColumnRenamed("a", "n"), [key, "n"], "left").withColumn("text", F.coalesce("_t", F.lit(""))).drop("_t")


def clean(c: Column) -> Column:
    """Line ends alike, several empty lines as one."""
    return F.regexp_replace(F.btrim(F.regexp_replace(c, r"\r\n?", "\n"), F.lit(" \n\t")), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")


def _markdown(pages: DataFrame, key: str, body: str, spans: DataFrame) -> DataFrame:
    """spans (key, begin, end, in the source) with content: that part of the page as Markdown."""
    cut = pages.select(key, F.col(body).alias("_body")).join(spans, key)
    part = F.regexp_replace(F.expr("substring(_body, begin + 1, greatest(end - begin, 0))"), r"(?is)<(noscript|svg|canvas)\b.*?</\1\s*>", "")
    made = clean(markup.html_markdown(part, F.lit(""))["markdown"])
    return cut.withColumn("content", F.coalesce(F.nullif(made, F.lit("")), F.lit(EMPTY))).drop("_body")


def _each(wanted: list[str]) -> Column:
    return F.explode(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))


def sections(pages: DataFrame, key: str, body: str, headings: Iterable[str]) -> DataFrame:
    """key, heading, content, error: what follows the first heading of that text, up to a heading beside it of no lower rank, or one of EXCLUDED_HEADINGS."""
    wanted = [h.strip() for h in headings]
    asked = F.broadcast(pages.sparkSession.createDataFrame([(h,) for h in wanted], "heading string"))
    found = nodes(pages, key, body)
    heads = texts(found, key, found.where(F.col("tag").rlike("^h[1-6]$"))).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    first = heads.join(asked, F.col("text") == F.col("heading")).withColumn("_k", F.row_number().over(Window.partitionBy(key, "heading").orderBy("n"))).where("_k = 1")
    first = first.select(key, "heading", "parent", "level", "n", F.col("end").alias("begin"))
    # a heading that ends the section; without one, it ends with the element around it
    stops = heads.select(key, F.col("parent").alias("p"), F.col("n").alias("m"), F.col("level").alias("l"), "text", F.col("begin").alias("stop"))
    beside = F.col("p").eqNullSafe(F.col("parent")) & (F.col("m") > F.col("n")) & ((F.col("l") <= F.col("level")) | F.col("text").isin(*EXCLUDED_HEADINGS))
    ends = first.join(stops, key).where(beside).groupBy(key, "heading").agg(F.min("stop").alias("stop"))
    around = found.select(key, F.col("n").alias("parent"), F.col("close").alias("around"))
    spans = first.join(ends, [key, "heading"], "left").join(around, [key, "parent"], "left")
    spans = spans.select(key, "heading", "begin", F.coalesce("stop", "around", F.lit(1 << 30)).alias("end"))
    made = _markdown(pages, key, body, spans).select(key, "heading", "content")
    rows = pages.select(key, _each(wanted).alias("heading")).join(made, [key, "heading"], "left")
    return rows.withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("no heading "), F.col("heading"))))


def downloads(pages: DataFrame, key: str, body: str, apps: Iterable[str]) -> DataFrame:
    """key, app, released, platforms, introduction, error: of the blocks with a date of update and the app's name before the introduction, the smallest."""
    wanted = [a.strip() for a in apps]
    asked = F.broadcast(pages.sparkSession.createDataFrame([(a,) for a in wanted], "app string"))
    found = nodes(pages, key, body)
    blocks = texts(found, key, found.where("tag IN ('div', 'li', 'dl')")).where(F.contains("text", F.lit(INTRODUCTION)) & F.col("text").rlike(DATED))
    blocks = blocks.withColumn("_at", F.instr("text", INTRODUCTION))
    fits = blocks.join(asked, F.contains(F.expr("substring(text, 1, _at - 1)"), F.col("app")))
    best = fits.groupBy(key, "app").agg(F.min_by(F.struct("text", "_at"), F.struct(F.length("text"), F.col("n"))).alias("b"))
    said, text = F.expr(f"substring(b.text, b._at + {len(INTRODUCTION)})"), F.col("b.text")
    platforms = F.array_compact(F.array(F.when(text.rlike("IOS|iOS"), "iOS"), F.when(text.rlike("android|安卓"), "Android")))
    told = best.select(
        key, "app", F.regexp_extract(text, DATED, 1).alias("released"), F.array_join(platforms, "、").alias("platforms"),
        F.coalesce(F.nullif(F.btrim(F.regexp_replace(said, BUTTONS, "")), F.lit("")), F.lit(EMPTY)).alias("introduction"),
    )
    rows = pages.select(key, _each(wanted).alias("app")).join(told, [key, "app"], "left")
    return rows.withColumn("error", F.when(F.col("released").isNull(), F.concat(F.lit("no app "), F.col("app"))))


def matches(found: DataFrame, selector: str) -> Column:
    """Whether a node fits a simple selector: a tag, .class or #id, or a tag with those."""
    parts = re.fullmatch(r"([A-Za-z][\w-]*)?((?:[.#][\w-]+)*)", selector.strip())
    if not parts or not selector.strip():
        raise ValueError(f"not a simple selector: {selector!r}")
    fits = found["tag"] == parts[1].lower() if parts[1] else found["tag"] != "#text"
    for sign, name in re.findall(r"([.#])([\w-]+)", parts[2]):
        fits = fits & (F.array_contains(found["classes"], name) if sign == "." else found["id"] == name)
    return fits


def cards(pages: DataFrame, key: str, body: str, apps: Iterable[str], card: str, name: str, content: str = ":self", excluded: Iterable[str] = ()) -> DataFrame:
    """key, app, content, error: the first card whose first name holds the app's, spaces aside; lines that begin with an excluded prefix go.

    card, name and content are simple selectors (see matches); :self takes the whole card.
    """
    wanted = [a.strip() for a in apps]
    asked = F.broadcast(pages.sparkSession.createDataFrame([(a, "".join(a.split())) for a in wanted], "app string, _bare string"))
    found = nodes(pages, key, body)
    held = found.where(matches(found, card)).select(key, F.col("n").alias("card"), "last", F.col("begin").alias("_b"), F.col("end").alias("_e"))

    def first_inside(selector: str) -> DataFrame:
        inner = found.where(matches(found, selector)).withColumnRenamed("last", "_last")
        inside = held.join(inner, key).where((F.col("n") > F.col("card")) & (F.col("n") <= F.col("last")))
        return inside.withColumn("_k", F.row_number().over(Window.partitionBy(key, "card").orderBy("n"))).where("_k = 1").drop("_k")

    names = texts(found, key, first_inside(name).select(key, "card", "n"))
    chosen = names.join(asked, F.contains(F.regexp_replace("text", r"\s+", ""), F.col("_bare"))).groupBy(key, "app").agg(F.min("card").alias("card"))
    spans = held.select(key, "card", F.col("_b").alias("begin"), F.col("_e").alias("end")) if content == ":self" else first_inside(content).select(key, "card", "begin", "end")
    made = _markdown(pages, key, body, chosen.join(spans, [key, "card"])).select(key, "app", "content")
    for prefix in excluded:
        cut = F.regexp_replace("content", rf"(?m)\Q{prefix}\E.*?(?=安卓版：|Android版：|HarmonyOS|$)", "")
        lines = F.filter(F.split(cut, "\n"), lambda x, p=prefix: ~F.startswith(F.trim(x), F.lit(p)))
        made = made.withColumn("content", F.coalesce(F.nullif(clean(F.array_join(lines, "\n")), F.lit("")), F.lit(EMPTY)))
    rows = pages.select(key, _each(wanted).alias("app")).join(chosen.select(key, "app", F.lit(True).alias("_there")), [key, "app"], "left").join(made, [key, "app"], "left")
    error = F.when(F.col("_there").isNull(), F.concat(F.lit("no app "), F.col("app"))).when(F.col("content").isNull(), F.concat(F.lit("no content for "), F.col("app")))
    return rows.withColumn("error", error).drop("_there")


def articles(bodies: DataFrame, key: str, body: str, keywords: Iterable[str] = MOBILE, block: str = "div.so-download-cont", suffix: str = ".apk") -> DataFrame:
    """key, app, content, error: blocks of the pages inside an answer's records that link to a file of that suffix and whose heading holds one of the keywords.

    An answer is JSON with data.records, each with a page as its content. What a block says without its heading
    and its buttons' labels, line by line, comes first, then its links.
    """
    contents = F.from_json(F.col(body), "data struct<records:array<struct<content:string>>>")["data"]["records"]
    pages = bodies.select(key, F.posexplode(contents).alias("_i", "_r")).select(F.concat_ws("\x1f", F.col(key).cast("string"), F.col("_i").cast("string")).alias("_page"), key, F.col("_r.content").alias("_html"))
    found = nodes(pages, "_page", "_html")
    held = found.where(matches(found, block)).select("_page", F.col("n").alias("block"), F.col("last").alias("_last"))
    inside = found.join(held, "_page").where((F.col("n") > F.col("block")) & (F.col("n") <= F.col("_last")))
    by_block = ["_page", "block"]
    heads = inside.where("tag = 'h2'").withColumn("_k", F.row_number().over(Window.partitionBy(*by_block).orderBy("n"))).where("_k = 1").select(*by_block, "n", F.col("last").alias("_until"), F.col("text"))
    heads = texts(found, "_page", heads).select(*by_block, F.col("n").alias("_head"), "_until", F.col("text").alias("app"))
    named = F.lit(False)
    for word in keywords:
        named = named | F.contains("app", F.lit(word))
    links = inside.where((F.col("tag") == "a") & F.endswith(F.lower("href"), F.lit(suffix))).groupBy(*by_block, "href").agg(F.min("n").alias("n"))
    links = links.groupBy(*by_block).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "href"))), lambda x: F.concat(F.lit("- 下载："), x["href"])), "\n").alias("_links"))
    chosen = heads.where(named).join(links, by_block)
    said = inside.where("tag = '#text'").join(chosen.select(*by_block, "_head", "_until"), by_block).where((F.col("n") < F.col("_head")) | (F.col("n") > F.col("_until")))
    lines = said.select(*by_block, "n", F.posexplode(F.split(F.btrim("text", F.lit(" \t\r\n")), r"\r?\n")).alias("k", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r\n")))
    lines = lines.where((F.col("line") != "") & ~F.col("line").isin(*LABELS)).groupBy(*by_block).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "line"))), lambda x: x["line"]), "\n").alias("_lines"))
    made = chosen.join(lines, by_block, "left").join(pages.select("_page", key), "_page")
    made = made.select(key, "app", clean(F.concat_ws("\n\n", "_lines", "_links")).alias("content"))
    readable = F.when(F.try_parse_json(F.col(body)).isNull(), "unreadable body").when(contents.isNull() | (F.size(contents) == 0), "no records").otherwise("no mobile app")
    rest = bodies.join(made.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("string").alias("app"), F.lit(None).cast("string").alias("content"), readable.alias("error"))
    return made.withColumn("error", F.lit(None).cast("string")).unionByName(rest)

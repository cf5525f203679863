"""HTML to Markdown, Column to Column."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that have no end, that are kept though empty, and that set their parts in paragraphs.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("div section article blockquote li".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def paragraphs(parts: list[str]) -> str:
    return "\n\n".join(x for x in (p.strip() for p in parts) if x)


class _Open:
    """An element that isn't closed yet: its converted parts, its list items or cells, its table's rows."""

    def __init__(self, tag: str, href: str = "") -> None:
        self.tag, self.href = tag, href
        self.parts: list[str] = []
        self.items: list[str] = []
        self.rows: list[list[str]] = []
        self.keep = False

    def markdown(self) -> str:
        plain = "".join(self.parts)
        bare = plain.strip()
        if not bare and not self.keep:
            return ""
        if re.fullmatch("h[1-6]", self.tag):
            return f"{'#' * int(self.tag[1])} {bare}\n"
        if self.tag == "p":
            return bare + "\n"
        if self.tag in BLOCKS:
            return paragraphs(self.parts)
        if self.tag in MARKS:
            return f"{MARKS[self.tag]}{bare}{MARKS[self.tag]}" if bare else ""
        if self.tag == "a":
            return f"[{bare or self.href}]({self.href})" if self.href else bare
        return plain

    def listed(self) -> str:
        marks = (f"{i}. " if self.tag == "ol" else "- " for i in range(1, len(self.items) + 1))
        return "\n".join(m + x for m, x in zip(marks, self.items, strict=True)) + "\n" if self.items else ""

    def table(self) -> str:
        if not self.rows:
            return ""
        wide = max(map(len, self.rows))
        rows = [r + [""] * (wide - len(r)) for r in self.rows]
        return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * wide, *rows[1:]]) + "\n"


class _Converter(HTMLParser):
    """One pass with a stack of open elements, so that depth costs no recursion; an element becomes text when it ends."""

    def __init__(self) -> None:
        super().__init__()
        self.stack = [_Open("div")]
        self.tags: dict[str, int] = {}
        self.hidden = ""

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in ("script", "style"):
            self.hidden = tag
        elif tag in VOID:
            self.stack[-1].keep |= tag in ("br", "img")
            self.stack[-1].parts.append("\n" if tag == "br" else "")
        else:
            self.stack.append(_Open(tag, (dict(attrs).get("href") or "").strip() if tag == "a" else ""))
            self.tags[tag] = self.tags.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = "" if tag == self.hidden else self.hidden
        elif self.tags.get(tag):
            while self.end() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.stack[-1].parts.append(data)

    def end(self) -> str:
        """Close the innermost element into the one around it."""
        one, outer = self.stack.pop(), self.stack[-1]
        self.tags[one.tag] -= 1
        outer.keep |= one.keep or one.tag == "table"
        if one.tag == "li" and outer.tag in ("ul", "ol"):
            if (text := one.markdown()) or one.keep:
                outer.items.append(text.replace("\n", "\n  ").strip())
        elif one.tag in ("td", "th") and outer.tag == "tr":
            outer.items.append("".join(one.parts).strip().replace("\n", "<br>").replace("|", r"\|"))
        elif one.tag == "tr":
            around = next((x for x in reversed(self.stack) if x.tag == "table"), outer)
            if any(one.items) or one.keep and one.items:
                around.rows.append(one.items)
        else:
            outer.parts.append(one.listed() if one.tag in ("ul", "ol") else one.table() if one.tag == "table" else one.markdown())
        return one.tag

    def result(self) -> str:
        self.close()
        while len(self.stack) > 1:
            self.end()
        return paragraphs(self.stack[0].parts)


def to_markdown(page: str | None) -> str:
    """Headings, emphasis, links, lists and tables of a page; scripts, styles and elements without text go; elements left open end with it.

    A table's cells hold a table inside them as text; its rows aren't repeated outside.
    """
    parser = _Converter()
    parser.feed(page or "")
    out = parser.result().replace("\xa0", " ")
    out = re.sub(r"(?i)\[if\s+!supportLists\]|\[endif\]", "", out)
    out = re.sub(r"[ \t\r\f\v]+", " ", out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", out)).strip()


def _markdown(s: pd.Series) -> pd.Series:
    return s.map(to_markdown)


def html_markdown(page: Column, plain: Column) -> Column:
    """Struct of markdown and warning: a page as Markdown, or the plain text where there is no page or nothing of it is left."""
    text = F.trim(F.coalesce(plain, F.lit("")))
    made = F.pandas_udf(_markdown, "string")(page)
    empty = F.coalesce(page, F.lit("")) == ""
    warning = F.when(empty, "no page; its text is used").when((made == "") & (text != ""), "nothing left of the page; its text is used")
    return F.struct(F.when(empty | (made == ""), text).otherwise(made).alias("markdown"), warning.alias("warning"))

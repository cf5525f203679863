"""Dates, numbers, hashes, addresses and JSON, Column to Column. What can't be read is null, never an error."""

from __future__ import annotations

import difflib
import functools
import html
import re
from collections import Counter
from html import entities
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track visitors.
TRACKING = ("bd_vid", "from", "mkt", "spm", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd")


def first_date(c: Column) -> Column:
    """The first year-month-day in a text, with - / . or 年月日 between; a date that isn't one is null."""
    pattern = r"(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.try_to_timestamp(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("--")), F.lit("y-M-d")).cast("date")


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Timestamp by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def positive_amount(*columns: Column) -> Column:
    """The first value that is a finite number above zero; thousands separators don't parse."""
    number = [c.try_cast("double") for c in columns]
    return F.coalesce(*[F.when((n > 0) & (n < float("inf")), n) for n in number])


def amount_with_units(c: Column) -> Column:
    """First number, with its sign, times 亿 or 万 wherever the text says so, commas removed, as an exact decimal."""
    bare = F.regexp_replace(c, ",", "")
    number = F.nullif(F.regexp_extract(bare, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("decimal(28,6)")
    unit = F.when(F.contains(bare, F.lit("亿")), 100000000).when(F.contains(bare, F.lit("万")), 10000).otherwise(1)
    return (number * unit).try_cast("decimal(20,2)")


def compact(c: Column) -> Column:
    """Up to four decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c.cast("double")), "0+$", ""), r"\.$", "")


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns, spaces collapsed and lower-cased, a unit separator between them."""
    bare = [F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *bare), 256)


def stable_id(digest: Column, *fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(digest), F.lit("")), F.sha1(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fallback])))


def tri_state(c: Column) -> Column:
    """true, false or null by vocabulary."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("true", "1", "yes", "y", "是"), True).when(x.isin("false", "0", "no", "n", "否"), False)


def host(url: Column) -> Column:
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www, default port, fragment, tracking parameters or last slash; parameters in order."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    netloc = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"^www\.", ""), r":(?:80|443)$", "")
    params = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.substring_index(F.lower(p), "=", 1).isin(*TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    return F.when(part(1) == "", F.lit(None)).otherwise(F.concat(F.lower(part(1)), F.lit("://"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def is_public_url(url: Column) -> Column:
    """http(s), without credentials, not local."""
    h = host(url)
    local = h.rlike(r"^(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)") | (h == "")
    return F.coalesce(url.rlike(r"^(?i:https?)://") & ~url.rlike(r"^[^/]+//[^/?#]*@") & ~local, F.lit(False))


def json_strings(c: Column) -> Column:
    """array<string>: a JSON array's elements, or the text itself as the only one; blank gives none."""
    parsed = F.from_json(c, "array<string>")
    is_array = F.trim(c).rlike(r"^\[") & parsed.isNotNull()
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<string>")).when(is_array, parsed).otherwise(F.array(F.trim(c)))


def supplier_text(c: Column) -> Column:
    """The names of a JSON array joined by 、, or the text with spaces collapsed."""
    x = F.coalesce(F.trim(c), F.lit(""))
    names = F.filter(F.transform(F.from_json(x, "array<string>"), lambda n: F.trim(n)), lambda n: n != "")
    return F.when(x.rlike(r"^\[") & names.isNotNull(), F.array_join(names, "、")).otherwise(F.regexp_replace(x, r"\s+", " "))


def candidate_text(c: Column) -> Column:
    """Candidates between semicolons of either width, trimmed, blanks left out, joined by one kind."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[;；]\s*"), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda x: x != ""), "; ")


def outermost_json(c: Column) -> Column:
    """The JSON of a model's answer: code fences off, then the whole, else from the first bracket to its last counterpart; null if unreadable."""
    bare = F.trim(F.regexp_replace(c, r"(?m)^\s*```[A-Za-z]*\s*$", ""))
    inner = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), F.lit("")))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))


def title_ratio(a: str, b: str) -> float:
    """0 without text, 1 if equal, 0.92 if one holds the other, else the sequence matcher's ratio (which depends on order)."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.92 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()


#: Titles come again in many pairs of rows: a worker keeps the ratios it told last.
_known_ratio = functools.lru_cache(1 << 16)(title_ratio)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_known_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def title_ratio_from(a: str, b: str, least: float) -> float:
    """title_ratio, or 0 if that is below least: characters in common, which bound the ratio, are counted first."""
    if not a or not b or a == b or a in b or b in a:
        return title_ratio(a, b)
    n = len(a) + len(b)
    if 2 * min(len(a), len(b)) / n < least or 2 * sum((Counter(a) & Counter(b)).values()) / n < least:
        return 0.0
    ratio = title_ratio(a, b)
    return ratio if ratio >= least else 0.0


def title_similarity_from(a: Column, b: Column, least: float) -> Column:
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([title_ratio_from(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


class _Text(HTMLParser):
    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol section article header footer blockquote".split())

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _unclosed(m: re.Match) -> str:
    known = m[1] and (m[1][0] == "#" or m[1] in entities.html5)
    return m[0] if known else f"&amp;{m[1] or ''}"


def html_to_text(page: str | None, closed: bool = False) -> str:
    """Text of a page: block tags end lines, list items begin with a dash, scripts and styles go.

    With closed, a character reference counts only with its semicolon; else also &amp and the like without one, as in browsers.
    """
    parser = _Text()
    parser.feed(re.sub(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?", _unclosed, page or "") if closed else page or "")
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


def _texts(s: pd.Series) -> pd.Series:
    return s.map(html_to_text)


def _closed_texts(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html_to_text(x, closed=True))


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def html_text(c: Column, closed: bool = False) -> Column:
    return F.pandas_udf(_closed_texts if closed else _texts, "string")(c)


def unescaped(c: Column) -> Column:
    """HTML entities decoded."""
    return F.pandas_udf(_unescaped, "string")(c)
